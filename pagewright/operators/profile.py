"""Runs whose language profile is the hypothesis: what may differ, what must not, and a smoke run on mixed languages.

A comparison is one row with structs control, candidate and smoke, so every rule is an expression over it and nothing is shuffled.
A run has provider, version, executable, psm, oem, target_dpi, padding, pixel_limit, languages, digest, models (language, size, sha256) and
crops (ref, padding, applied, resized); control and candidate also runtime (provider, version, languages, models) and document_digests.
An unknown value breaks a rule, but for fields whose expected value is null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import DIGEST, compact

#: Fields that both sides and the smoke run must share.
SHARED = ("psm", "oem", "target_dpi", "padding", "pixel_limit")
ENGINE = ("provider", "version", "executable")
RUNTIME = ("provider", "version", "languages", "models")


@dataclass(frozen=True)
class Contract:
    """Fixed values of the experiment; they are the inputs' own."""

    control: Sequence[str] = ("jpn", "eng")
    candidate: Sequence[str] = ("jpn",)
    fixed: dict[str, object] = field(default_factory=lambda: {"psm": 6, "oem": 3, "target_dpi": None, "padding": 2})
    smoke_source: str = ""
    protected: Sequence[str] = ()
    smoke_literals: Sequence[str] = ()
    smoke_groups: Sequence[Sequence[str]] = ()


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _unless(*rules: tuple[str, Column]) -> Column:
    """Codes of the rules that don't hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules]))


def _languages(models: Column) -> Column:
    return F.transform(models, lambda m: m["language"])


def invocation_reasons(side: str, run: Column, languages: Sequence[str], c: Contract) -> Column:
    """What is wrong with one side alone: fixed values, languages and models, runtime against invocation, crops, digests."""
    crop = f"{side}:crop:"
    told = F.flatten(F.transform(F.coalesce(run["crops"], F.array()), lambda x, i: F.array_compact(F.array(
        F.when(~F.coalesce(F.length(x["ref"]) > 0, F.lit(False)), F.format_string(f"{crop}%d:region_ref", i)),
        F.when(~F.coalesce((x["padding"] == c.fixed["padding"]) & x["applied"], F.lit(False)), F.format_string(f"{crop}%d:padding", i)),
    ))))
    return F.concat(
        _unless(
            *[(f"{side}:configuration:{name}", run[name].eqNullSafe(F.lit(value))) for name, value in c.fixed.items()],
            (f"{side}:configuration:languages", run["languages"] == _strings(languages)),
            (f"{side}:parameters_digest", run["digest"].rlike(DIGEST)),
            *[(f"{side}:runtime:{name}", run["runtime"][name].eqNullSafe(run[name])) for name in RUNTIME],
            (f"{side}:resized_crop", (F.size(run["crops"]) > 0) & ~F.exists(run["crops"], lambda x: F.coalesce(x["resized"], F.lit(True)))),
            (f"{side}:padding_crops", F.size(run["crops"]) > 0),
            (f"{side}:document_parameters_digest", F.array_distinct(run["document_digests"]) == F.array(run["digest"])),
        ),
        told,
    )


def profile_reasons(control: Column, candidate: Column, c: Contract) -> Column:
    """C11, C4: only the ordered languages, their models and the digest differ between the sides, and the digest does."""
    same = [(f"mismatch:configuration:{name}", control[name].eqNullSafe(candidate[name])) for name in SHARED]
    same += [(f"mismatch:{name}", control[name].eqNullSafe(candidate[name])) for name in (*ENGINE, "crops")]
    left, right = control["models"], candidate["models"]
    gone = [x for x in c.control if x not in c.candidate]
    return F.concat(
        invocation_reasons("control", control, c.control, c),
        invocation_reasons("candidate", candidate, c.candidate, c),
        _unless(
            *same,
            ("control:model_languages", _languages(left) == _strings(c.control)),
            ("candidate:model_languages", _languages(right) == _strings(c.candidate)),
            ("mismatch:shared_model", (F.size(left) == 0) | (F.size(right) == 0) | F.get(left, F.lit(0)).eqNullSafe(F.get(right, F.lit(0)))),
            *[(f"candidate:{x}_model_present", ~F.array_contains(_languages(right), x)) for x in gone],
            ("candidate:parameters_digest_unchanged", ~control["digest"].eqNullSafe(candidate["digest"])),
            ("candidate:parameters_digest_does_not_identify_hypothesis", ~F.arrays_overlap(control["document_digests"], candidate["document_digests"])),
        ),
    )


def smoke_reasons(smoke: Column, candidate: Column, c: Contract) -> Column:
    """The smoke run reads the fixed source with the candidate's settings, engine and models, as one whole page without padding."""
    crop = F.get(smoke["crops"], F.lit(0))
    return _unless(
        ("smoke:source_sha256", smoke["source_sha256"] == c.smoke_source),
        ("smoke:parameters_digest", smoke["digest"].rlike(DIGEST)),
        ("smoke:languages", smoke["languages"] == _strings(c.candidate)),
        *[(f"smoke:mismatch:configuration:{name}", smoke[name].eqNullSafe(candidate[name])) for name in SHARED],
        *[(f"smoke:mismatch:{name}", smoke[name].eqNullSafe(candidate[name])) for name in (*ENGINE, "models")],
        ("smoke:full_page_crop", (F.size(smoke["crops"]) == 1) & crop["ref"].isNull() & (crop["padding"] == 0) & ~crop["applied"]),
    )


def regressions(control_text: Column, candidate_text: Column, smoke_text: Column, c: Contract) -> Column:
    """Protected literals that only the control has, and literals or groups of them that the smoke run lacks; white space doesn't count."""
    left, right, smoke = (compact(F.coalesce(t, F.lit(""))) for t in (control_text, candidate_text, smoke_text))
    return _unless(
        *[(f"regression:protected_literal:{x}", ~F.contains(left, F.lit(x)) | F.contains(right, F.lit(x))) for x in c.protected],
        *[(f"regression:smoke:literal:{x}", F.contains(smoke, F.lit(x))) for x in c.smoke_literals],
        *[(f"regression:smoke:any_group:{i}", reduce(Column.__or__, [F.contains(smoke, F.lit(x)) for x in g])) for i, g in enumerate(c.smoke_groups)],
    )


def language_decisions(comparisons: DataFrame, key: Sequence[str], c: Contract) -> DataFrame:
    """(key, decision, reasons): a broken rule makes a comparison invalid; a regression overrules every decision but that.

    comparisons: key, control, candidate, smoke, control_text, candidate_text, smoke_text, and decision and reasons by the scores alone.
    """
    broken = F.concat(profile_reasons(F.col("control"), F.col("candidate"), c), smoke_reasons(F.col("smoke"), F.col("candidate"), c))
    told = comparisons.select(*key, "decision", "reasons", broken.alias("_broken"), regressions(F.col("control_text"), F.col("candidate_text"), F.col("smoke_text"), c).alias("_worse"))
    invalid = (F.size("_broken") > 0) | (F.col("decision") == "invalid")
    worse = ~invalid & (F.size("_worse") > 0)
    reasons = F.when(invalid, F.col("_broken")).when(worse, F.concat("reasons", "_worse")).otherwise(F.col("reasons"))
    decision = F.when(invalid, "invalid").when(worse, "regressed").otherwise(F.col("decision"))
    return told.select(*key, decision.alias("decision"), F.array_distinct(reasons).alias("reasons"))


def relabelled(comparisons: DataFrame, documents: DataFrame, key: Sequence[str], names: dict[str, str]) -> DataFrame:
    """C17: a common result under an older report's names, with the digest of each document's source, which its JSON holds."""
    at = "$.extensions.extract.source_sha256"
    digest = F.variant_get(F.parse_json("content"), at, "string")
    return comparisons.withColumnsRenamed(names).join(documents.select(*key, digest.alias("document_source_sha256")), list(key), "left")
