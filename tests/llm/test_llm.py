"""The corpus operators against SQL, brute force and awkward tables."""

import hashlib
import zlib

import numpy as np
import pytest

from wayfold.llm import balance, imatch, licences, line_runs, mcd, packing, queries, similar, token_store, tokens, toxicity, url_lists
from wayfold.llm.common import stash_path

LONG = "The quick brown fox jumps over the lazy dog near the old mill by the river\n" * 3
PASSAGE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (3, LONG, "en", "a", 1), (4, LONG, "en", None, 1), (None, "null id", "en", "b", 7),
    (5, " \t\n ", "de", "b", 4), (6, f"One line.\n{PASSAGE}\nEnd.", "en", "b", 9), (7, f"Other.\n{PASSAGE}\nEnds.", "en", "b", 9), (7, "again 7", "en", "a", 7),
    (8, "x " * 30000, "fr", "a", 60000), (9, "Grüße  aus  Köln \x00 <|endoftext|> é́", "de", "é", 20), (10, LONG, "en", "a", 1), (10, LONG, "en", "a", 1),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, part int, term string, size string, block string, node long, score double, copies string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "t", "s", "b", 1, 0.5, "c") for r in ROWS], COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (6, 0, 1), (None, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


def ops(spark, labels):
    word, byte = tokens.default_path("word_bpe_49k.json"), tokens.default_path("byte_bpe_50k.json")
    return {
        "imatch": lambda d: imatch.with_edits(d),
        "prints": lambda d: imatch.fingerprints(d),
        "mcd": mcd.outliers,
        "mix": balance.mix,
        "licences": lambda d: licences.scan(d, licences.known_licences(spark)),
        "toxicity": lambda d: toxicity.score_documents(d, labels),
        "lines": line_runs.report,
        "similar": similar.join,
        "orc": lambda d: token_store.token_index(token_store.encode_to_orc(d, byte, stash_path(spark, "t"))),
        "pack": lambda d: packing.pack_documents(d, word).where("piece = 0"),
    }


NAMES = ["imatch", "prints", "mcd", "mix", "licences", "toxicity", "lines", "similar", "orc", "pack"]


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows_each_give_one_row(spark, odd, labels, name):
    assert sorted(str(r.doc_id) for r in ops(spark, labels)[name](odd).collect()) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, none, labels, name):
    assert ops(spark, labels)[name](none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, duck, rows_of, name):
    assert rows_of(queries.queries()[name](spark, small).toPandas()) == rows_of(duck.sql(queries.oracle_sql()[name]).df())


def brute_print(text: str, lexicon: list[str], least: int) -> str:
    """The fingerprint by plain integers: for each subset a polynomial in the mixed hashes of its terms, in their order."""
    import xxhash

    own = sorted(imatch.terms(text))
    kept = [t for t in own if t in set(lexicon)]
    kept = own if len(kept) < least else kept
    top, out = 1 << 64, ""
    for k in range(len(imatch.RATES) * imatch.SUBSETS):
        total, n = 0, 0
        for t in kept:
            x = (xxhash.xxh64_intdigest(t) ^ xxhash.xxh64_intdigest(f"subset {k}")) * 0x9E3779B97F4A7C15 % top
            x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % top
            if x <= top // imatch.RATES[k // imatch.SUBSETS] - 1:
                total, n = (total + x * pow(0x9E3779B97F4A7C15, n, top)) % top, n + 1
        total = (total ^ (total >> 31)) * 0xFF51AFD7ED558CCD % top
        out += f"{(total >> 40) % 0xFFFF + 1 if n else 0:04x}"
    return out


def test_prints_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    counts = {}
    for t in texts.values():
        for term in imatch.terms(t):
            counts[term] = counts.get(term, 0) + 1
    lexicon = [t for t, n in counts.items() if max(2, imatch.LOW * len(texts)) <= n <= max(2, imatch.HIGH * len(texts))]
    assert sorted(lexicon) == imatch.lexicon(docs)
    rows = {r.doc_id: r for r in imatch.with_edits(docs).collect()}
    order = sorted(texts)
    for a, b in list(zip(order, order[1:] + order[:1]))[::8]:
        changed = imatch.edited(texts[a], texts[b])
        own, its, next_ = (brute_print(t, lexicon, imatch.LEAST) for t in (texts[a], changed, texts[b]))
        assert (rows[a].fingerprint, rows[a].edited_fingerprint) == (own, its)
        as_array = lambda h: np.frombuffer(bytes.fromhex(h), dtype=">u2")
        assert rows[a].near_edited == imatch.likeness(as_array(own), as_array(its)) and rows[a].near_next == imatch.likeness(as_array(own), as_array(next_))


def test_few_terms_in_the_band(spark):
    """On both sides of `least`: three terms in the band or four, and a text with none under least = 0."""
    rows = [(1, "aa bb cc x1"), (2, "aa bb cc x2"), (3, "aa bb cc dd x3"), (4, "aa bb cc dd x4"), (5, "x5 x6"), *((k, f"y{k}") for k in range(6, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    band = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs, least=4).collect()}
    assert band[1] != band[2] and band[3] == band[4]
    none = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs, least=0).collect()}
    assert none[1] == none[2] != none[3] and set(none[5]) == {"0"}
    near = {r.doc_id: r.near_next for r in imatch.with_edits(docs, least=0).collect()}
    assert near[1] == 1.0 and near[3] == 1.0


def test_edits_and_prints(spark, odd):
    rows = {r.doc_id: r for r in imatch.with_edits(odd.where("doc_id in (1, 2, 3, 4, 5, 6)")).collect()}
    order = sorted(rows)
    text = {r[0]: r[1] or "" for r in ROWS if r[0] in rows}
    for a, b in zip(order, order[1:] + order[:1]):
        want = imatch.edited(text[a], text[b])
        assert rows[a].edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and rows[a].n_chars == len(text[a])
    assert rows[3].fingerprint == rows[4].fingerprint and rows[3].near_next == 1.0


def test_edits_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = {tuple(r) for r in imatch.with_edits(docs, rows_per_part=1000).collect()}
    assert one == {tuple(r) for r in imatch.with_edits(docs.repartition(7), rows_per_part=9).collect()}


def test_ends_of_ranges_meet(spark):
    """Ranges 0, 1, 4 and 5, with none between 1 and 4."""
    lasts = [(0, 10, "a", None), (1, None, "b", None), (4, 40, "", None), (5, 50, "e", None)]
    heads = [(-1, None, None, "A"), (0, None, None, ""), (3, None, None, "D"), (4, None, None, "E")]
    rows = spark.createDataFrame(lasts + heads, "part int, doc_id long, text string, next_text string").repartition(3)
    found = {tuple(r) for r in imatch.range_ends(rows).collect()}
    assert found == {(10, "a", ""), (None, "b", "D"), (40, "", "E"), (50, "e", "A")}
    one = rows.where("part = 0 and text is not null or part = -1")
    assert [tuple(r) for r in imatch.range_ends(one).collect()] == [(10, "a", "A")] and imatch.range_ends(rows.where("false")).count() == 0


def test_text_statistics_by_hand():
    text = "a b c d\na b c e\n\na b c d\n# $"
    words = text.split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 3)}
    assert mcd.text_statistics(text) == (len(words), 14, 2, 1, len(inside), 4, 2, 7)
    assert mcd.text_statistics("") == (0,) * 8


def test_outliers_keep_clean_and_reject_junk(spark, small):
    found = mcd.outliers(spark.read.parquet(f"{small}/documents.parquet")).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").toPandas()
    asked = found[~found.base_failed]
    assert asked[asked.quality == 1].kept.mean() > 0.97 and asked[asked.quality == 0].kept.mean() < 0.2
    good = found[~found.base_failed]
    sizes = good.groupby(["lang_x", "source_x"] if "lang_x" in good else ["lang", "source"], dropna=False).transform("size")
    assert ((sizes >= mcd.LEAST_ROWS) == (good["pool"] == 0)).all() and (good[good["pool"] == 0].pool_rows == sizes[good["pool"] == 0]).all()
    assert (good[good["pool"] > 0].pool_rows >= mcd.LEAST_ROWS).all()


def test_outliers_in_one_share_only(spark):
    """Texts usual in all but repeated lines or words are rejected; words are drawn as in prose, so some repeat by chance."""
    rng = np.random.default_rng(7)
    fresh = lambda n: [f"w{k:04d}" for k in rng.choice(10000, n, replace=False)]
    drawn = lambda n: [f"w{int(k):04d}" for k in np.minimum(rng.pareto(0.3, n) * 10, 99_999)]
    tens = lambda words: "\n".join(" ".join(words[i : i + 10]) for i in range(0, len(words), 10))
    texts = []
    for k in range(300):
        words = drawn(int(rng.integers(150, 260)))
        cuts = [0, *np.cumsum(rng.integers(7, 14, 40)).tolist()]
        text = "\n".join(" ".join(words[i:j]) for i, j in zip(cuts, cuts[1:]) if i < len(words))
        texts.append(text + ("\n" + " ".join(words[:10]) if k % 7 == 0 else ""))
    line, rest, half = " ".join(fresh(10)), fresh(200), fresh(100)
    both = "\n".join([*[line] * 10, " ".join(fresh(100))])
    lines_only = "\n".join(x for k in range(20) for x in ("w0000", " ".join(rest[10 * k : 10 * k + 9])))
    words_only = tens([*half[:45], "x0001", *half[:45], *half[45:], *fresh(45)])
    assert mcd.text_statistics(both)[:4:3] == (200, 9) and mcd.text_statistics(both)[4] == 100
    assert mcd.text_statistics(lines_only)[3:6] == (19, 0, 40) and mcd.text_statistics(words_only)[3:5] == (0, 90)
    docs = spark.createDataFrame(list(enumerate([*texts, both, lines_only, words_only])), "doc_id long, text string").selectExpr("*", "'en' lang", "'a' source")
    found = {r.doc_id: r for r in mcd.outliers(docs).collect()}
    assert [(found[k].base_failed, found[k].kept) for k in (300, 301, 302)] == [(False, False)] * 3
    assert sum(found[k].kept for k in range(300)) >= 297


def test_starts_reach_the_least_determinant_of_all_subsets():
    import itertools

    rng = np.random.default_rng(1)
    for seed in range(4):
        x = rng.normal(size=(15, 3)) @ rng.normal(size=(3, 3))
        x[:3] += 9
        ridge = np.full(3, 1e-9)
        least = min(np.linalg.slogdet(np.cov(x[list(s)].T, bias=True))[1] for s in itertools.combinations(range(15), mcd.kept_rows(15)))
        found = mcd.least_determinants(x, ridge)
        assert abs(found[0][0] - least) < 1e-6 and found[0][0] <= found[-1][0]


def test_estimates_over_all_rows_equal_one_process(spark):
    """Groups beyond the sample: distributed C-steps end where C-steps over all rows in one process do."""
    rng = np.random.default_rng(2)
    mixing = rng.normal(size=(mcd.P, mcd.P))
    rows = []
    for gid in range(2):
        x = rng.normal(size=(4000, mcd.P)) @ mixing + gid
        x[:600] += rng.normal(6, 3, (600, mcd.P))
        rows += [(k, gid, *map(float, r)) for k, r in enumerate(x)]
    good = spark.createDataFrame(rows, "doc_id long, gid long, " + ", ".join(f"x{i} double" for i in range(mcd.P)))
    table = np.array([r[2:] for r in rows])
    ridge = mcd.RIDGE * table.var(axis=0) + 1e-12
    for r in mcd.estimates(good).collect():
        own = np.array([x[2:] for x in rows if x[1] == r.gid])
        least, centre, cov = mcd.least_determinants(own, ridge)[0]
        assert r.n == 4000 and r.log_det <= least + 1e-3
        assert np.abs(np.array([r[f"m{i}"] for i in range(mcd.P)]) - centre).max() < 0.02
        inverse = np.linalg.inv(cov)
        assert all(abs(r[f"p{i}{j}"] - inverse[i, j]) < 0.03 * np.sqrt(inverse[i, i] * inverse[j, j]) for i in range(mcd.P) for j in range(i, mcd.P))


def test_covariance_alone_separates_outliers(spark):
    """Texts whose statistics are each usual, but not together: long ones with as few distinct words as short ones have."""
    rng = np.random.default_rng(3)
    word = lambda k: "w" * int(k % 7) + "".join(chr(97 + int(d)) for d in str(int(k))) + ("," if rng.random() < 0.1 else "")
    text = lambda n, pool: "\n".join(" ".join(word(k) for k in rng.integers(0, pool, rng.integers(4, 30))) + "." for _ in range(n // 16))
    texts = [text(int(np.exp(rng.normal(6.0, 0.7)).clip(100, 3000)), int(rng.integers(1500, 3000))) for _ in range(400)] + [text(1200, 120) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' lang", "'a' source")
    found = mcd.outliers(docs).orderBy("doc_id").toPandas()
    alone = found.n_distinct[:400]
    assert alone.min() < found.n_distinct[400:].min() and found.n_distinct[400:].max() < alone.max()
    assert not found.base_failed[400:].any() and not found.kept[400:].any() and found.kept[:400].mean() > 0.97


def test_laws_of_the_cutoff():
    rng = np.random.default_rng(4)
    assert abs(mcd.beta_cdf(0.3, 2.5, 4.0) - (rng.beta(2.5, 4.0, 400_000) <= 0.3).mean()) < 0.004
    assert abs(mcd.chi2_cdf(4.0, 5) - (rng.chisquare(5, 400_000) <= 4.0).mean()) < 0.004
    assert mcd.cutoff(30) > mcd.cutoff(100) > mcd.cutoff(10_000) > mcd.quantile(lambda x: mcd.chi2_cdf(x, mcd.P), mcd.LEVEL)


def test_mix_meets_targets(spark, small):
    found = balance.mix(spark.read.parquet(f"{small}/documents.parquet")).toPandas()
    assert (found.taken <= 2 * found["size"]).all()
    by = found.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 * by.target.sum()
    assert ((by.taken - by.target).abs() / by.target).max() < 0.05


def wrapped(text: str, width: int, mark: str) -> str:
    import textwrap

    lines = []
    for part in text.split("\n\n"):
        lines += [mark + x for x in textwrap.wrap(" ".join(part.split()), width)] + [mark.rstrip()]
    return "\n".join(lines[:-1])


def test_licences_at_every_width_and_behind_comment_marks(spark):
    names = ["MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "BSL-1.0", "Apache-2.0", "MPL-2.0"]
    known = dict(reversed(licences.all_known()))
    rows = [(k, name, wrapped(known[name], width, mark)) for k, (name, width, mark) in enumerate((n, w, m) for n in names for w in range(50, 121) for m in ("", " * ", "# ", "// ") if not m or w % 10 == 0)]
    docs = spark.createDataFrame(rows, "doc_id long, name string, text string")
    found = {r.doc_id: r.licence for r in licences.scan(docs, licences.known_licences(spark)).collect()}
    assert [(n, t[:200]) for k, n, t in rows if found[k] != n] == []


def test_notices_go_and_lines_that_begin_alike_stay(spark):
    texts = ["Copyright 2020 A", "(c) Copyright 2021, B", "© C", " * Copyright (C) <year> D", "Portions copyright 1999 E", "Copyright The F Authors", "All rights reserved.", "body"]
    body = ["copyright holders be liable", "copyright owner or contributors", "copyright notice and this", "(c) you must retain", "the copyright 2020 x"]
    rows = spark.createDataFrame([("\n".join(texts),), ("\n".join(body),), ("Sub-licence  the\nnon-commercial   copyright\nowner's licences, fulfil",)], "text string")
    found = [r[0] for r in rows.select(licences.canonical(rows["text"])).collect()]
    assert found[0] == "body"
    assert found[1] == "copyright holders be liable copyright holder or contributors copyright notice and this c you must retain the copyright 2020 x"
    assert found[2] == "sublicense the noncommercial copyright holder s licenses fulfill"


def test_licence_variants_match(spark):
    mit = dict(licences.KNOWN)["MIT"]
    changed = mit.replace("Copyright (c) <year> <copyright holders>", "Copyright 2020 Someone\nCopyright 2021 Else").replace("License", "LICENCE").replace(",", " ;")
    docs = spark.createDataFrame([(1, changed), (2, mit + " more"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in licences.scan(docs, licences.known_licences(spark)).collect()} == {1: "MIT", 2: None, 3: None}


def test_every_licence_is_found_among_documents(spark):
    rows = licences.all_known()
    docs = spark.createDataFrame([(k, f"a document {k}", 1) for k in range(15 * len(rows))] + [(None, None, 1)], "doc_id long, text string, k long")
    found = licences.scan(licences.variants(docs), licences.known_licences(spark)).collect()
    names = {-k - 1: rows[k % len(rows)][0] for k in range(15 * len(rows))}
    assert len(found) == 2 * docs.count()
    assert [(r.doc_id, r.licence) for r in found if r.doc_id is not None and r.licence != names.get(r.doc_id)] == []
    assert sorted(str(r.licence) for r in found if r.doc_id is None) == ["MIT", "None"]


def test_usual_licences_and_titles_match(spark):
    mit = dict(licences.KNOWN)["MIT"].partition("\n\n")[2]
    texts = {p.stem: p.read_text() for p in (licences.Path(licences.__file__).parent / "licence_texts").glob("*.txt")}
    asked = [("MIT", mit), ("MIT", "The MIT License (MIT)\n\n" + mit), *((n, "  " + t.upper()) for n, t in texts.items()), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + texts["BSD-3-Clause"])]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(asked)], "doc_id long, text string")
    found = {r.doc_id: r.licence for r in licences.scan(docs, licences.known_licences(spark)).collect()}
    assert len(texts) >= 11 and [found[k] for k in range(len(asked))] == [n for n, _ in asked]


def test_url_lists_by_hand(spark):
    entries = spark.createDataFrame(
        [("bad.com", "block", 100), ("bad.com", "unlist", 200), ("ok.bad.com", "allow", 150), ("bad.com", "block", 9_000_000), (None, "block", 1)], "pattern string, action string, s long"
    ).selectExpr("pattern", "action", "timestamp_seconds(s) listed_at")
    seen = [(1, "http://x.bad.com/a", 99), (2, "http://x.bad.com/a", 100), (3, "https://u@ok.bad.com:8/", 150), (4, "http://bad.com", 200), (5, "http://bad.com", 99_000_000), (6, None, 5), (7, "nothing", None), (2, "http://x.bad.com/a", 100)]
    rows = spark.createDataFrame(seen, "page_id long, url string, s long").selectExpr("page_id", "url", "timestamp_seconds(s) fetched_at", "1 host")
    found = sorted((r.page_id, r.blocked, r.pattern) for r in url_lists.judge(rows, entries).collect())
    assert found == [(1, False, None), (2, True, "bad.com"), (2, True, "bad.com"), (3, False, "ok.bad.com"), (4, False, None), (5, True, "bad.com"), (6, False, None), (7, False, None)]
    assert url_lists.judge(rows.where("false"), entries).count() == 0 and url_lists.judge(rows, entries.where("false")).count() == 8


def test_busy_domains_are_dealt(spark):
    """A listed parent of two thirds of all captures, an unlisted top-level domain of all, and one host's time with a third."""
    seen = [(k, f"http://h{k % 300}.busy.com/", 100 + k % 7) for k in range(1200)] + [(k, f"http://z{k}.net.com/", 103) for k in range(1200, 1500)] + [(k, "http://one.com/", 104) for k in range(1500, 2300)]
    listed = [("busy.com", "block", 101), ("busy.com", "allow", 103), ("h5.busy.com", "block", 104), ("one.com", "block", 104), ("busy.com", "unlist", 105)]
    rows = spark.createDataFrame(seen, "page_id long, url string, s long").selectExpr("page_id", "url", "timestamp_seconds(s) fetched_at")
    entries = spark.createDataFrame(listed, "pattern string, action string, s long").selectExpr("pattern", "action", "timestamp_seconds(s) listed_at")

    def verdict(url: str, at: int) -> tuple:
        names = url[7:-1].split(".")
        for name in (".".join(names[i:]) for i in range(len(names))):
            acts = [a for p, a, s in sorted(listed, key=lambda e: e[2]) if p == name and s <= at]
            if acts and acts[-1] != "unlist":
                return name, acts[-1]
        return None, None

    found = {(r.page_id, r.pattern, r.action, r.blocked) for r in url_lists.judge(rows, entries).collect()}
    assert found == {(k, *verdict(u, s), verdict(u, s)[1] == "block") for k, u, s in seen}
    tried = rows.selectExpr("explode(array('busy.com', 'com', url)) pattern")
    busy = {r.pattern: (r.shares, r.listed) for r in url_lists.busy_patterns(tried, url_lists.intervals(entries), 3 * len(seen)).collect()}
    assert busy["com"] == busy["busy.com"][:1] + (False,) and busy["busy.com"] == (-(-len(seen) // 6), True)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_whole_encoding(name):
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = [r[1] or "" for r in ROWS] + ["a  b", "x  y", "tab\t z", "it's, ok...\n\nno", " lead", "trail ", "\n", "a̸, ﬁ Ǆ", "日本 語, ok", "a <|endoftext|> b", "x<|startoftext|>y, <|EndOfText|> z"]
    whole = Tokenizer.from_file(tokens.default_path(name))
    wanted = [np.array(x.ids, dtype="<u4").tobytes() for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert tokens.encoder(tokens.default_path(name)).encode(pa.array(texts)) == wanted


def test_special_strings_as_text():
    import pyarrow as pa

    path, ids = tokens.default_path("byte_bpe_50k.json"), lambda x: np.frombuffer(x, dtype="<u4").tolist()
    assert ids(tokens.encoder(path).encode(pa.array(["a <|endoftext|> b"]))[0]) == [64, 220, 50256, 275]
    assert 50256 not in ids(tokens.encoder(path, specials_as_text=True).encode(pa.array(["a <|endoftext|> b"]))[0])


def test_orc_round_trip_and_pruning(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    target = stash_path(spark, "orc")
    stored = token_store.encode_to_orc(docs, tokens.default_path("byte_bpe_50k.json"), target)
    index = token_store.token_index(stored).orderBy("doc_id").collect()
    at = 0
    for r in index:
        assert r.start == at
        at += r.n_tokens
    row = token_store.read_orc(spark, target, [17]).first()
    assert zlib.crc32(np.array(row.ids, dtype="<u4").tobytes()) == index[17].ids_crc32


def test_packing_is_tight_and_whole():
    lengths = np.random.default_rng(1).integers(1, 2048, 3000)
    bins, starts = packing.best_two_fit(lengths, 2048)
    load = np.bincount(bins, weights=lengths)
    assert load.max() <= 2048 and len(load) <= 1.01 * lengths.sum() / 2048 + 1
    for b in range(0, len(load), 97):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(starts[own])]
        assert (starts[own] == np.r_[0, np.cumsum(lengths[own])[:-1]]).all()


def test_two_replace_the_smallest():
    bins, _ = packing.best_two_fit(np.array([60, 30, 25, 14]), 100)
    assert sorted(np.flatnonzero(bins == bins[0]).tolist()) == [0, 2, 3]


def test_sequences_hold_the_pieces(spark, odd):
    packed = packing.pack_documents(odd, tokens.default_path("word_bpe_49k.json"))
    total = packed.agg({"length": "sum"}).first()[0]
    found = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in found) == total and max(len(r.ids) for r in found) <= 2048


def test_weights_by_naive_search():
    rng = np.random.default_rng(9)
    words = {" bad ": 2.0, " awfu": 3.0, " awful ": 2.5, " x": 1.0}
    matcher = toxicity.automaton(words, ("bad luck",))
    pool = ["bad", "luck", "awful", "awfully", "x1", "fine", "BAD", "b4d", "a"]
    for _ in range(200):
        text = " ".join(rng.choice(pool, rng.integers(0, 12)))
        folded, total, hits = toxicity.fold(text), 0.0, 0
        free = [i for i in range(len(folded)) if folded.startswith(" bad luck ", i)]
        for at in range(len(folded)):
            own = [w for e, w in words.items() if folded.startswith(e, at)]
            if own and not any(f <= at < f + len(" bad luck ") - 1 for f in free):
                total, hits = total + max(own), hits + 1
        assert toxicity.weigh(matcher, text) == (total, hits, len(folded.split()))


def test_no_entry_is_cut_off(spark):
    """Hundreds of words that only toxic texts have are all kept."""
    bad = [f"bad{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(600)]
    rows = [(" ".join(bad[k % 5 :: 5]) + f" w{k}", 1) for k in range(200)] + [(f"w{k} fine words here", 0) for k in range(1000)]
    found = toxicity.lexicon(spark.createDataFrame(rows, "text string, toxic long"))
    folded = [toxicity.fold(w) for w in bad]
    assert all(any(f.startswith(e) for e in found) for f in folded)


def test_folding_and_exceptions():
    assert toxicity.fold("Аn 1d10t, m0r0n 2024 $tupid!") == " an idiot moron 2024 stupid "
    found = toxicity.automaton({" trash ": 2.0, " idio": 3.0})
    assert toxicity.weigh(found, "a trash can, idi0ts") == (3.0, 1, 4)
    assert toxicity.weigh(found, "the TRASH") == (2.0, 1, 2)


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    found = toxicity.score_documents(spark.read.parquet(f"{data}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.toxic).mean() > 0.93


def brute_runs(texts: dict[int, str], least: int = 50) -> dict[int, int]:
    """Lines deleted from each text: those in a run of `least` words whose lines stand earlier."""
    lines = {d: [(i, " ".join(x.split())) for i, x in enumerate(t.split("\n")) if x.split()] for d, t in texts.items()}
    seen, gone = set(), {d: set() for d in texts}
    for d in sorted(lines):
        own = lines[d]
        spans = [(i, j) for i in range(len(own)) for j in range(i + 1, len(own) + 1)]
        for i, j in spans:
            words = [len(x.split()) for _, x in own[i:j]]
            if sum(words) >= least and (sum(words[1:]) < least or sum(words[:-1]) < least):
                key = tuple(x for _, x in own[i:j])
                if key in seen:
                    gone[d].update(n for n, _ in own[i:j])
                seen.add(key)
    return {d: len(g) for d, g in gone.items()}


def test_line_runs_by_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = [" ".join(f"w{k}x{i}" for i in range(rng.integers(1, 25))) for k in range(12)]
    texts = {d: "\n".join([*(pool[k] for k in rng.integers(0, 12, rng.integers(1, 14))), ""] * int(rng.integers(1, 3))) for d in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_runs.report(docs).collect()} == brute_runs(texts)


def test_many_rows_of_one_key_join_like_few(spark):
    from wayfold.llm import common

    rows = spark.createDataFrame([(k, 0 if k % 3 else k) for k in range(3000)] + [(3000, None)], "i long, k long")
    table = rows.where("k is not null").groupBy("k").count().withColumnRenamed("count", "n")
    found = common.join_counted(rows, table, ["k"], 3001)
    assert sorted((r.i, r.n) for r in found.collect()) == sorted((k, 2001 if k % 3 or not k else 1) for k in range(3000))
    assert common.join_counted(rows, table, ["k"], 3001, "left").where("n is null").count() == 1


def brute_links(texts: list[str]) -> list[int]:
    sets = [set(similar.shingles(t).tolist()) for t in texts]
    hit = lambda a, b: a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9
    return [sum(1 for j, b in enumerate(sets) if j != i and hit(a, b)) for i, a in enumerate(sets)]


def test_similar_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 5000, 120).tolist() for _ in range(4)]
    texts = []
    for k in range(420):
        words = list(base[0 if k < 300 else k % 4])
        for _ in range(rng.integers(0, 6)):
            words[rng.integers(0, len(words))] = int(rng.integers(5000, 9000))
        texts.append(" ".join(map(str, words)))
    texts += ["", "short one", "short one", "a b c d e", "a b c d f"]
    found = similar.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_links for r in found] == brute_links(texts)
    assert found[-4].class_id == found[-3].doc_id - 1 and found[-1].n_links == 0


def test_partners_away_from_the_centre_of_a_large_group(spark):
    from wayfold.llm.components import components

    rng = np.random.default_rng(11)
    fresh = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    changed = lambda own, at: np.r_[np.delete(own, at), fresh(len(at))]
    centre, sets = fresh(300), []
    for k in range(500):
        a = changed(centre, rng.choice(300, 33, replace=False))  # 267 kept from the centre stand first
        sets += [a, changed(a, rng.choice(267, 33, replace=False)), changed(centre, rng.choice(300, 2, replace=False))]
    rows = [(k, bytearray(similar.signature(np.unique(x)))) for k, x in enumerate(sets)]
    root = {r.node: r.root for r in components(similar.candidates(spark.createDataFrame(rows, "set_id long, sig binary"))).collect()}
    assert [k for k in range(0, 1500, 3) if root.get(k, -1) != root.get(k + 1, -2)] == []
    assert similar.lost_odds(similar.RUNS) <= 1 - similar.RECALL


def test_repeated_rows_of_a_representative(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(1, text), (1, text), (2, text + " more"), (1, "another text of doc 1"), (3, text + " other")]
    found = similar.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found) == [(1, 1, 0), (1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 1, 3)]


def test_one_of_a_class_stays_though_ids_repeat(spark):
    words = lambda c: " ".join(f"{c}{k}" for k in range(100))
    a, b = words("a"), words("b")
    rows = [(0, b), (1, a), (1, b + " more"), (2, a + " x"), (3, a), (None, b + " y"), (None, words("n")), (None, words("n") + " z"), (4, None), (4, None), (5, ""), (6, " "), (0, words("c"))]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, parent string, n int")
    kept = similar.keep_one(frame)
    assert kept.columns == frame.columns
    found = sorted(str((r.doc_id, r.text)) for r in kept.collect() if r.doc_id is not None)
    assert found == sorted(map(str, [(0, b), (1, a), (4, None), (5, ""), (6, " "), (0, words("c"))]))
    assert [r.text.startswith("n0") for r in kept.where("doc_id is null").collect()] == [True]
    assert similar.keep_one(frame.limit(0)).count() == 0


def test_one_of_a_class_stays_by_brute_force(spark):
    """Random near copies under repeated ids: what stays is one row of each component of the link graph."""
    rng = np.random.default_rng(21)
    rows = []
    for k in range(120):
        base = [f"t{k // 6}w{i}" for i in range(60)]
        for _ in range(int(rng.integers(0, 3))):
            base[int(rng.integers(0, 60))] = f"x{k}"
        rows.append((int(rng.integers(0, 40)), " ".join(base)))
    sets = [set(similar.shingles(t).tolist()) for _, t in rows]
    root = list(range(120))
    for i in range(120):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                root = [root[j] if r == root[i] else r for r in root]
    kept = [(r.doc_id, r.text) for r in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    groups = {}
    for (doc, text), r in zip(rows, root):
        groups.setdefault(r, []).append((doc, text))
    assert len(kept) == len(groups)
    for own in groups.values():
        here = [x for x in kept if x in own]
        assert len(here) == 1 and here[0][0] == min(d for d, _ in own)


def test_one_large_cluster_is_sent_a_few_times(spark):
    """Sets of one cluster are sent once for every BLOCK sets, so 3000 near copies make 6000 rows, not 3000 x 12."""
    rng = np.random.default_rng(13)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(3000):
        words = list(base)
        words[int(rng.integers(0, 200))] = f"x{k}"
        texts.append(" ".join(words))
    found = similar.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    sets = [set(similar.shingles(t).tolist()) for t in texts]
    for k in range(0, 3000, 300):
        assert found.n_links[found.doc_id == k].iloc[0] == sum(len(sets[k] & s) >= 0.8 * len(sets[k] | s) - 1e-9 for s in sets) - 1
    assert found.class_id.nunique() == 1


def test_stages_with_awkward_rows(spark, odd, none, labels, tmp_path):
    """Nulls, ties, repeated rows and ids, clashing extra columns and no rows, in every stage of the pipeline."""
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    wanted = {"toxicity": len(ROWS), "line dedup": len(ROWS), "mixing sources to target weights": None, "n-gram Jaccard join": 9}  # of the three LONG texts one stays, and of 6 and 7, which share a passage, 6
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd, str(tmp_path)).toPandas()
        assert stage(spark, none, str(tmp_path)).count() == 0
        if name in wanted:
            assert list(found.columns) == corpus_pipeline.COLUMNS
            assert wanted[name] is None or len(found) == wanted[name], name
    mixed = balance.mix(odd).toPandas()
    assert len(balance.repeat(odd, balance.mix(odd)).toPandas()) == mixed.copies.sum()


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, small)
        assert left.columns == docs.columns
        path = stash_path(spark, "stage")
        left.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() > 50
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 2048
