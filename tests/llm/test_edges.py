"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import pytest

import corpus_pipeline
from plumbline.llm import bpe, decontaminate, histosort, language, linededup, outliers, secrets, simhash, spans, warc
from plumbline.llm.common import DOCUMENT_COLUMNS
from pyspark.sql import functions as F

from .fixtures import DE, EN, docs, empty, odd


def benchmark(spark):
    return spark.createDataFrame([(1, EN), (2, None), (3, ""), (None, EN), (4, "too short")], "item_id bigint, text string")


FIND = {
    "lines": lambda s, d: linededup.duplicates(d),
    "histosort": lambda s, d: histosort.sharded(d, "doc_id", F.octet_length("text"), 1000),
    "contaminated": lambda s, d: decontaminate.contaminated(d, benchmark(s)),
    "secrets": lambda s, d: secrets.scan(d),
    "outliers": lambda s, d: outliers.outliers(d),
    "language": lambda s, d: language.predict(d),
    "bpe": lambda s, d: bpe.encode(d),
    "spans": lambda s, d: spans.changed(d),
    "simhash": lambda s, d: simhash.groups(d),
}
FILTER = {
    "lines": lambda s, d: linededup.without_duplicates(d),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, benchmark(s)),
    "outliers": lambda s, d: outliers.without_outliers(d),
    "language": lambda s, d: language.identified(d),
    "spans": lambda s, d: spans.without_repeats(d),
    "simhash": lambda s, d: simhash.deduplicated(d),
}


@pytest.mark.parametrize("name", FIND)
def test_odd_rows(spark, name):
    got = FIND[name](spark, odd(spark)).collect()
    plain = FIND[name](spark, odd(spark, extra=False)).collect()
    assert len(got) == len(plain)
    if name in ("outliers", "language", "bpe", "histosort"):
        assert len(got) == 13
    assert FIND[name](spark, empty(spark)).count() == 0


@pytest.mark.parametrize("name", FILTER)
def test_odd_rows_filtered(spark, name):
    got = FILTER[name](spark, odd(spark))
    assert got.columns == list(DOCUMENT_COLUMNS)
    assert got.count() <= 13
    nothing = FILTER[name](spark, empty(spark))
    assert nothing.count() == 0 and nothing.columns == list(DOCUMENT_COLUMNS)


def test_null_ids_stay(spark):
    for name in ("lines", "outliers", "spans", "simhash", "decontaminate"):
        assert FILTER[name](spark, odd(spark)).where("doc_id is null").count() == 1, name


def test_blocks_of_benchmark(spark, monkeypatch):
    items = spark.createDataFrame([(1, EN), (2, None), (3, EN[30:]), (None, EN), (4, EN), (4, DE), (5, DE[20:])], "item_id bigint, text string")
    d = odd(spark).union(docs(spark, [(4, DE), (None, DE + EN), (6, "other " + EN)], extra=True))
    both = lambda: [sorted(map(repr, x.collect())) for x in (decontaminate.contaminated(d, items), decontaminate.decontaminate(d, items))]
    one = both()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 50)
    assert len(decontaminate._blocks(items)) > 5
    assert both() == one and len(one[1]) == 16
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 2)
    assert both() == one


def test_pipeline_stages(spark):
    d = odd(spark)
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, d, "").columns == list(DOCUMENT_COLUMNS)


def test_pipeline_by_hand(spark, tmp_path):
    """run's rows against plain loops: every stage on what the one before left."""
    import random
    import re

    import tiktoken

    from .test_methods import edited, levenshtein, prose

    r = random.Random(22)
    language_ = {"en": EN.split(), "de": DE.split()}
    said = lambda lang, n: " ".join("".join(r.choices("aeiou", k=2)) + w for w in r.choices(language_[lang], k=n))
    items = [prose(r, 14), "zebra quagga okapi gnu eland kudu oryx", "Yes"]
    shared = [said("en", 9) for _ in range(6)]
    rows = []
    for k in range(90):
        lang = "de" if k % 3 == 0 else "en"
        lines = [said(lang, 10) for _ in range(r.randint(4, 7))]
        if k % 5 == 0:
            lines.insert(r.randrange(len(lines)), edited(r, r.choice(shared), r.randint(0, 2)))
        if k % 7 == 0:
            lines[1] += " " + r.choice(items[:2]).upper() + ", " + said(lang, 3)
        rows.append((k, "\n".join(lines), lang, "s"))
    near = rows[40][1].split()
    rows += [(100, " ".join([*near[:20], "entirely", *near[21:]]), "en", "s"), (101, None, "en", "s"), (102, "", "en", "s"), (103, "漢字" * 50, None, "s"), (104, rows[3][1], "de", "s")]
    full = docs(spark, rows)
    full.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    # languages: by dense scores, tested elsewhere; here what is foreign or empty must have gone, and all else stayed
    accepted = {x.doc_id for x in language.predict(full).where("accepted").collect()}
    assert accepted.isdisjoint({101, 102, 103}) and len(accepted) >= 85
    texts = {k: t for k, t, *_ in rows if k in accepted}
    # lines
    earlier: list = []
    for k in sorted(texts):
        kept = []
        for line in texts[k].split("\n"):
            x = line.strip()
            if x and not any(x == y or (min(len(x), len(y)) > 2 and abs(len(x) - len(y)) < 3 and levenshtein(x, y) <= 2) for y in earlier):
                kept.append(line)
            elif not x:
                kept.append(line)
            earlier.append(x)
        texts[k] = "\n".join(kept)
    texts = {k: t for k, t in texts.items() if t.strip()}
    assert 104 not in texts
    # near duplicates
    ids, halves = simhash.signatures_of([texts[k] for k in sorted(texts)])
    sign = {sorted(texts)[i]: (int(a) & (1 << 64) - 1) | (int(b) & (1 << 64) - 1) << 64 for i, (a, b) in zip(ids, halves)}
    leader = {k: k for k in sign}
    for a in sorted(sign):
        for b in sorted(sign):
            if a < b and (sign[a] ^ sign[b]).bit_count() <= simhash.DISTANCE:
                old, new = leader[b], leader[a]
                leader = {k: min(old, new) if v in (old, new) else v for k, v in leader.items()}
    texts = {k: t for k, t in texts.items() if leader.get(k, k) == k}
    assert 100 not in texts
    # benchmark passages
    phrases = []
    for item in items:
        w = item.lower().split()
        phrases += [w[j : j + decontaminate.WORDS] for j in range(max(1, len(w) - decontaminate.WORDS + 1))]
    hits = 0
    for k, t in texts.items():
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", t)]
        cut = set()
        for p in phrases:
            for j in range(len(words) - len(p) + 1):
                if [x[2] for x in words[j : j + len(p)]] == p and len(p) >= decontaminate.LEAST:
                    cut.update(range(words[j][0], words[j + len(p) - 1][1]))
        hits += bool(cut)
        texts[k] = "".join(c for i, c in enumerate(t) if i not in cut)
    assert hits > 5
    # token ids
    tokens = bpe.load_tokens("/opt/tokenizers/" + bpe.VOCABULARY)
    real = tiktoken.Encoding("own", pat_str=__import__("public_tokenizers").PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    assert set(got) == set(texts)
    for k, t in texts.items():
        assert got[k].token_ids == real.encode_ordinary(t) and got[k].n_bytes == len(t.encode()) and got[k].round_trip


def test_warc_edges(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, None), (None, "u", ""), (3, "http://a", "<p>" + "y " * 50_000 + "</p>"), (3, "http://a", "<p>z</p>"), (3, "http://a", "<p>z</p>")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, content string, headers string")
    got = warc.derivatives(warc.responses(pages)).collect()
    assert len(got) == 12
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
    assert sum(r.content_length == 0 for r in got if r.warc_type == "conversion") == 2


def test_single_language(spark):
    got = language.predict(docs(spark, [EN] * 3 + ["123"])).orderBy("doc_id").collect()
    assert [r.predicted_lang for r in got] == ["en", "en", "en", None]
    assert [r.accepted for r in got] == [True, True, True, False]
