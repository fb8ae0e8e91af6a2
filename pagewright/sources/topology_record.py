"""The nested record of a page's tables: its rules for strict reading, its rows, and checks of the ids that it refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.match import by_page
from pagewright.sources.nested import Rule, canonical_digest, depth_of, sound_rows, strict_issues

#: Roles of lines and rectangles, the record's version and its coordinates.
ROLES = ("page_frame", "page_decoration", "table_outer_border", "row_boundary", "column_boundary", "cell_rectangle", "duplicated_supporting_primitive", "unassigned")
VERSION, COORDINATES = "1.0", "document-ir-points"
#: Lists of ids in the diagnostics, and the fields that hold ids of recognised texts.
DIAGNOSTICS = ("ambiguous_text_element_ids", "unassigned_text_element_ids", "ambiguous_primitive_element_ids", "unassigned_primitive_element_ids", "rejected_table_outer_element_ids")
TEXT_IDS = ("text_element_ids", "ambiguous_text_element_ids", "unassigned_text_element_ids")
#: Columns with the ids that a record may refer to, by kind.
KNOWN = {kind: f"_known_{kind}" for kind in ("text", "primitive", "rectangle")}
BOX = "struct<x: double, y: double, width: double, height: double>"
SOURCE = "struct<stage: string, provider: string, provider_version: string, source_element_ids: array<string>, parameters_digest: string>"
AXIS = "array<struct<id: string, index: long, start: double, end: double>>"
CELL = f"struct<id: string, row_index: long, column_index: long, rowspan: long, colspan: long, bbox: {BOX}, supporting_element_ids: array<string>, text_element_ids: array<string>, confidence: double, provenance: {SOURCE}>"
TABLE = f"struct<id: string, bbox: {BOX}, logical_grid: struct<rows: long, columns: long>, rows: {AXIS}, columns: {AXIS}, cells: array<{CELL}>, supporting_element_ids: array<string>, confidence: double, provenance: {SOURCE}>"
ROLE = "struct<element_id: string, role: string, table_id: string, cell_id: string, duplicate_of_element_id: string>"
RECORD = (
    f"struct<schema_version: string, provider: string, provider_version: string, coordinate_space: string, boundary_tolerance_pt: double, tables: array<{TABLE}>, "
    f"primitive_roles: array<{ROLE}>, diagnostics: struct<{', '.join(f'{d}: array<string>' for d in DIAGNOSTICS)}>>"
)


def fields(struct: str) -> tuple[str, ...]:
    """The names of a struct's own fields, from its DDL."""
    depth, names, word = 0, [], ""
    for c in struct[struct.index("<") + 1 : -1]:
        depth += (c == "<") - (c == ">")
        if c == ":" and depth == 0:
            names.append(word.strip())
        word = "" if c in ",:" and depth == 0 else word + c
    return tuple(names)


def rules(provider: str, provider_version: str) -> list[Rule]:
    """What a record must look like at every depth; ``provider`` and its version are those of the writer."""

    def box(at: str) -> list[Rule]:
        return [Rule(at, "object", fields(BOX)), *[Rule(f"{at}.{f}", "number", least=0) for f in fields(BOX)]]

    def ids(at: str) -> list[Rule]:
        return [Rule(at, "array"), Rule(f"{at}[]", "string")]

    def source(at: str) -> list[Rule]:
        fixed = (("stage", "derived"), ("provider", provider), ("provider_version", provider_version))
        return [Rule(at, "object", fields(SOURCE)), *[Rule(f"{at}.{f}", "string", allowed=(v,)) for f, v in fixed], *ids(f"{at}.source_element_ids"), Rule(f"{at}.parameters_digest", "string", pattern="^[0-9a-f]{64}$")]

    out = [Rule("$", "object", fields(RECORD))]
    fixed = (("schema_version", VERSION), ("provider", provider), ("provider_version", provider_version), ("coordinate_space", COORDINATES))
    out += [Rule(f"$.{f}", "string", allowed=(v,)) for f, v in fixed] + [Rule("$.boundary_tolerance_pt", "number", above=0)]
    t = "$.tables[]"
    out += [Rule("$.tables", "array"), Rule(t, "object", fields(TABLE)), Rule(f"{t}.id", "string"), *box(f"{t}.bbox"), Rule(f"{t}.logical_grid", "object", ("rows", "columns"))]
    out += [Rule(f"{t}.logical_grid.{f}", "integer", least=1) for f in ("rows", "columns")]
    for axis in ("rows", "columns"):
        a = f"{t}.{axis}[]"
        out += [Rule(f"{t}.{axis}", "array"), Rule(a, "object", ("id", "index", "start", "end"), rising=("start", "end"), rising_code="invalid_axis"), Rule(f"{a}.id", "string"), Rule(f"{a}.index", "integer", least=0), *[Rule(f"{a}.{f}", "number", least=0) for f in ("start", "end")]]
    c = f"{t}.cells[]"
    out += [Rule(f"{t}.cells", "array"), Rule(c, "object", fields(CELL)), Rule(f"{c}.id", "string"), *box(f"{c}.bbox")]
    out += [Rule(f"{c}.{f}", "integer", least=n) for f, n in (("row_index", 0), ("column_index", 0), ("rowspan", 1), ("colspan", 1))]
    for at in (t, c):
        out += [*ids(f"{at}.supporting_element_ids"), Rule(f"{at}.confidence", "number", least=0, most=1), *source(f"{at}.provenance")]
    out += ids(f"{c}.text_element_ids")
    r = "$.primitive_roles[]"
    out += [Rule("$.primitive_roles", "array"), Rule(r, "object", ("element_id", "role"), ("table_id", "cell_id", "duplicate_of_element_id")), Rule(f"{r}.role", "string", allowed=ROLES)]
    out += [Rule(f"{r}.{f}", "string") for f in ("element_id", "table_id", "cell_id", "duplicate_of_element_id")]
    out += [Rule("$.diagnostics", "object", DIAGNOSTICS), *[x for d in DIAGNOSTICS for x in ids(f"$.diagnostics.{d}")]]
    return out


def read_topologies(rows: DataFrame, key: str, content: str, provider: str, provider_version: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a typed ``topology`` and no issue, issues (key, path, code)); records with an issue are left out of the first.

    An axis that doesn't end after its start is an issue as well. Nothing is written out or moved: each side reads the texts in one pass.
    """
    told = rules(provider, provider_version)
    sound = sound_rows(rows, content, told)
    return sound.withColumn("topology", F.from_json(F.col(content), RECORD)), strict_issues(rows, key, content, told)


def token_free_digests(rows: DataFrame, key: str, content: str) -> DataFrame:
    """X11: (key, digest) of records without the ids of recognised texts: two records with one digest have the same tables and cells."""
    return canonical_digest(rows, key, content, depth_of(rules("", "")), TEXT_IDS)


def topology_differences(control: DataFrame, candidate: DataFrame, key: str, content: str) -> DataFrame:
    """X11: (key, control_digest, candidate_digest, same); a record on one side only isn't the same."""
    a = token_free_digests(control, key, content).withColumnRenamed("digest", "control_digest")
    b = token_free_digests(candidate, key, content).withColumnRenamed("digest", "candidate_digest")
    return a.join(by_page(b), key, "full_outer").withColumn("same", F.coalesce(F.col("control_digest") == F.col("candidate_digest"), F.lit(False)))


def known_ids(text: Column, rectangle: Column, line: Column | None = None) -> list[Column]:
    """Columns for reference_issues() from arrays of a record's element ids by type, where these are at hand before its text is read."""
    none = F.array().cast("array<string>")
    found = {"text": text, "primitive": rectangle if line is None else F.concat(rectangle, line), "rectangle": rectangle}
    return [F.coalesce(ids, none).alias(KNOWN[kind]) for kind, ids in found.items()]


def reference_issues(typed: DataFrame, elements: DataFrame | None, key: str) -> DataFrame:
    """V9: (doc_id, path, code) for ids in records. elements: (key, ref, type), or None if the records have the columns of known_ids().

    duplicate_id and unknown_element name the place in a list; invalid_support_reference a cell whose support isn't in its table's, and
    invalid_provenance a source list that isn't exactly the support; invalid_role_reference a role with an unknown table, cell or line.
    A record meets its elements once, as arrays of ids, and all of its lists are looked through there; nothing is taken apart and joined.
    """
    of = lambda *types: F.collect_set(F.when(F.col("type").isin(*types), F.col("ref")))
    rows, none = typed, F.array().cast("array<string>")
    if elements is not None:
        packed = elements.groupBy(key).agg(of("text").alias("_t"), of("rectangle").alias("_r"), of("line").alias("_l"))
        rows = typed.join(by_page(packed), key, "left").select(*typed.columns, *known_ids(*[F.coalesce(c, none) for c in ("_t", "_r", "_l")]))
    at = lambda path, i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
    issue = lambda path, code: F.struct(path.alias("path"), F.lit(code).alias("code"))
    empty = F.array().cast("array<struct<path: string, code: string>>")
    when = lambda flag, path, code: F.when(flag, F.array(issue(path, code))).otherwise(empty)
    each = lambda items, f: F.coalesce(F.flatten(F.transform(items, f)), empty)  # noqa: E731  f: of an item and its place

    def ids(path: Column, kind: str, listed: Column) -> Column:
        known = F.col(KNOWN[kind])
        return each(listed, lambda x, i: F.concat(
            when(F.array_position(listed, x) <= i, at(path, i), "duplicate_id"), when(~F.coalesce(F.array_contains(known, x), F.lit(False)), at(path, i), "unknown_element"),
        ))

    def source(path: Column, x: Column) -> Column:
        return when(~x["provenance"]["source_element_ids"].eqNullSafe(x["supporting_element_ids"]), F.concat(path, F.lit(".provenance.source_element_ids")), "invalid_provenance")

    def cell(path: Column, own: Column, x: Column) -> Column:
        support = F.concat(path, F.lit(".supporting_element_ids"))
        return F.concat(
            ids(support, "primitive", x["supporting_element_ids"]), ids(F.concat(path, F.lit(".text_element_ids")), "text", x["text_element_ids"]),
            when(F.size(F.array_except(x["supporting_element_ids"], own)) > 0, support, "invalid_support_reference"), source(path, x),
        )

    def table(x: Column, t: Column) -> Column:
        path, own = at(F.lit("$.tables"), t), x["supporting_element_ids"]
        return F.concat(ids(F.concat(path, F.lit(".supporting_element_ids")), "primitive", own), source(path, x), each(x["cells"], lambda c, i: cell(at(F.concat(path, F.lit(".cells")), i), own, c)))

    tables = F.col("topology.tables")
    table_ids = F.coalesce(F.transform(tables, lambda t: t["id"]), none)
    cell_ids = F.coalesce(F.flatten(F.transform(tables, lambda t: F.transform(t["cells"], lambda c: c["id"]))), none)

    def role(x: Column, i: Column) -> Column:
        path = at(F.lit("$.primitive_roles"), i)
        twin = x["duplicate_of_element_id"]
        lost = twin.isNotNull() & ~F.coalesce(F.array_contains(KNOWN["primitive"], twin), F.lit(False))
        return F.concat(when(~F.array_contains("_tables", x["table_id"]) | ~F.array_contains("_cells", x["cell_id"]), path, "invalid_role_reference"), when(lost, F.concat(path, F.lit(".duplicate_of_element_id")), "invalid_role_reference"))

    told = [each(tables, table), each(F.col("topology.primitive_roles"), role)]
    for d in DIAGNOSTICS:
        told.append(ids(F.lit(f"$.diagnostics.{d}"), "text" if "text" in d else "rectangle" if "outer" in d else "primitive", F.col(f"topology.diagnostics.{d}")))
    found = rows.withColumns({"_tables": table_ids, "_cells": cell_ids}).select(F.col(key).alias("doc_id"), F.explode(F.concat(*told)).alias("i"))
    return found.select("doc_id", "i.path", "i.code")


def infer_missing(pages: DataFrame, held: DataFrame, infer, page: list[str]) -> DataFrame:
    """Records of a whole corpus: those there are stay as they are, pages without one get what ``infer`` finds for them.

    pages: page columns; held: page columns and topology; infer: a function of the pages that lack a record, which returns page columns and
    topology, with no row for a page without a closed grid. Adds inferred; pages without either have no row, so a second run changes nothing.
    """
    lacking = pages.join(by_page(held.select(*page)), page, "left_anti")
    return held.select(*page, "topology", F.lit(False).alias("inferred")).unionByName(infer(lacking).select(*page, "topology", F.lit(True).alias("inferred")))
