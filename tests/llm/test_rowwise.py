"""Media columns, license scans, URL filters and token counts on small inputs and against brute force."""

import hashlib
import io
import zlib

import numpy as np
import pytest

from pagewright.llm import licenses, media, queries, tokens, urls
from tests.conftest import SF

TEXTS = [None, "", "a", "Straße 12\u00a0\u2003x\x1c y", "the the  the\n\n\nthe ", "a<|endoftext|>b<|endoftext|>", "it's I'LL we'll", "x" * 3000, "日本語の文章 \U0001f600\U0001f600", " \t ", "word " * 500]
DOCS = "doc_id long, text string, lang string, n_tokens_ string"


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)


def test_token_counts_agree_with_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    rows = tokens.count_tokens(frame(spark), tokenizer=path).collect()
    for r in rows:
        text = r.text or ""
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids), text[:40]
        assert r.n_bytes == len(text.encode())
    whole = queries.op10_token_counts(spark, SF).collect()
    docs = {d.doc_id: d.text or "" for d in queries.read(spark, SF, "documents").collect()}
    assert {r.doc_id: r.n_tokens for r in whole} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
    assert tokens.count_tokens(frame(spark, []), tokenizer=path).count() == 0


def test_forgetting_pieces_changes_no_count(spark):
    path = queries.tokenizer_path()
    one = [r.n_tokens for r in tokens.count_tokens(frame(spark), tokenizer=path).collect()]
    assert one == [r.n_tokens for r in tokens.count_tokens(frame(spark), tokenizer=path, remember=1).collect()]


def test_text_images_keep_every_byte(spark):
    rows = media.media_features(media.text_images(frame(spark))).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        payload = (r.text or "").encode()
        payload += bytes(-len(payload) % 64 if payload else 64)
        f = r.features
        assert media.decode(bytes(r.media)).tobytes() == payload
        assert f.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert f.tail_crc32 == zlib.crc32(payload[-64:]) and f.payload_bytes == len(payload)
        assert f.media_sha256 == hashlib.sha256(r.media).hexdigest() and f.media_bytes == len(r.media)
        assert np.load(io.BytesIO(f.tile)).shape == (media.TILE, media.TILE)


@pytest.mark.parametrize("held", [1, 100, 1 << 20])
def test_resize_is_the_area_mean(held):
    rng = np.random.default_rng(1)
    for h, w in [(1, 1), (5, 7), (64, 64), (3, 200)]:
        pixels = rng.integers(0, 256, (h, w)).astype(np.uint8)
        fine = np.repeat(np.repeat(pixels, 8, axis=0), 9, axis=1).astype(float)
        want = fine.reshape(8, h, 9, w).mean(axis=(1, 3))
        assert np.allclose(media.resize(pixels, 8, 9, held), want)


def test_netpbm_and_bmp_kinds():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(b"P2 # plain\n4 3\n255\n" + b" ".join(b"%d" % x for x in range(12))) == grey).all()
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(np.pad(grey, ((0, 0), (0, 1))))) == np.pad(grey, ((0, 0), (0, 1)))).all()
    assert media.decode(b"P6 1 1 255 \x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P1 2 1 1 0").tolist() == [[0, 255]]
    assert media.decode(b"P4 2 1 \x80").tolist() == [[0, 255]]
    assert media.decode(b"P5 1 1 65535 \x01\x00").tolist() == [[256]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_broken_images_give_nulls(spark):
    rows = media.media_features(spark.createDataFrame([(None,), (b"GIF",), (b"P5 9 9 255 x",), (b"",)], "media binary")).collect()
    assert rows[0].features is None
    assert all(r.features.payload_sha256 is None and r.features.media_bytes is not None for r in rows[1:])


def test_licenses_are_found_in_whole_texts(spark):
    filler = "lorem ipsum the license of dolor " * 400
    texts = [
        None, "", "no license here", filler + "Released under the MIT License. " + filler,
        "This work is licensed under the GNU General Public License, version 3.\n" * 3,
        "released UNDER the (mit) license!!", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", filler,
        "Licensed under the Apache License, Version 2.0.",
    ]
    found = [r.found and r.found.license for r in licenses.scan_licenses(frame(spark, texts)).collect()]
    assert found == [None, None, None, "MIT", "GPL-3.0", "MIT", "CC-BY-NC-4.0", None, "Apache-2.0"]
    full = licenses.scan_licenses(frame(spark, ["x y " + licenses.TEMPLATES["MIT-text"].replace("free of charge", "") + " z"])).first().found
    assert full.license == "MIT-text" and 0.9 < full.coverage < 1


def test_patience_matches_rise_on_both_sides():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 8, rng.integers(0, 20)).tolist(), rng.integers(0, 8, rng.integers(0, 20)).tolist()
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert licenses.patience(a, a) == [(i, i) for i in range(len(a))]


def test_license_query_finds_every_notice_line(spark):
    docs = {d.doc_id: d.text or "" for d in queries.read(spark, SF, "documents").collect()}
    found = {r.doc_id for r in queries.op2_license_scans(spark, SF).where("license is not null").collect()}
    assert {i for i, t in docs.items() if any(n in t for n in list(licenses.TEMPLATES.values())[:4])} <= found


URLS = [None, "", "no scheme", "http://", "https://A.Example.COM/en/7#x", "http://com/en/", "http://b.example.net/de/80?q", "http://example.net/de", "x://net/de/9", "http://xnet/de/9", "ftp://org:80/es/", "http://a.org?/es/", "http://..org/es/x"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i, c in enumerate(rest) if c in "/?#"] + [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, `Rule` string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, urls.rule_table(spark)).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS * 2)}
    assert urls.filter_urls(pages, urls.rule_table(spark).where("false")).where("verdict = 'allow'").count() == len(URLS) * 2
    assert urls.filter_urls(pages.limit(0), urls.rule_table(spark)).count() == 0


OPERATORS = {
    "media": lambda df: media.media_features(media.text_images(df)),
    "found": licenses.scan_licenses,
    "n_tokens": lambda df: tokens.count_tokens(df, tokenizer=queries.tokenizer_path()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_repeated_rows_and_clashing_names(spark, name):
    notice = min(licenses.TEMPLATES.values(), key=len)
    texts = [notice, notice, None, None, "", f"a {notice} b"]
    plain = OPERATORS[name](frame(spark, texts)).collect()
    assert plain[0][name] == plain[1][name] and plain[2][name] == plain[3][name]
    clashing = frame(spark, texts).withColumnRenamed("lang", name)
    rows = OPERATORS[name](clashing)
    assert rows.columns.count(name) == 1 and [r[name] for r in rows.collect()] == [r[name] for r in plain]
    assert OPERATORS[name](frame(spark, [])).count() == 0
