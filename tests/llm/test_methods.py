"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import random
import re

import numpy as np
import pytest

from plumbline.llm import bpe, decontaminate, histosort, language, linededup, outliers, secrets, simhash, spans, warc
from plumbline.llm.components import components
from pyspark.sql import functions as F

from .fixtures import DE, EN, docs

WORDS = "ash birch cedar dogwood elm fir gum hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak umbrella vine willow yew zelkova".split()


def prose(r, n):
    return " ".join(r.choices(WORDS, k=n))


def edited(r, text, n):
    for _ in range(n):
        k = r.randrange(len(text) + 1)
        text = r.choice((text[:k] + text[k + 1 :], text[:k] + "q" + text[k:], text[:k] + "z" + text[k + 1 :]))
    return text


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    r = random.Random(1)
    a = [prose(r, r.randint(1, 8)) for _ in range(300)] + ["", "a", "ab"]
    b = [edited(r, x, r.randint(0, 4)) if x else "abc" for x in a]
    assert linededup.edit_distances(a, b, 2).tolist() == [min(3, levenshtein(x, y)) for x, y in zip(a, b)]


def test_lines(spark):
    r = random.Random(2)
    base = [prose(r, 5) for _ in range(40)]
    texts = ["\n".join(edited(r, r.choice(base), r.randint(0, 3)) for _ in range(6)) for _ in range(30)]
    lines = [(d, k, line.strip()) for d, t in enumerate(texts) for k, line in enumerate(t.split("\n")) if len(line.strip()) >= 20]
    want = {(d, k) for n, (d, k, x) in enumerate(lines) if any(abs(len(x) - len(y)) < 3 and levenshtein(x, y) <= 2 for _, _, y in lines[:n])}
    got = {(x.doc_id, k) for x in linededup.duplicates(docs(spark, texts)).collect() for k in x.removed}
    assert got == want and want
    left = linededup.without_duplicates(docs(spark, texts)).collect()
    assert sum(len(x.text.split("\n")) for x in left) == sum(len(t.split("\n")) for t in texts) - len(want)


def test_short_lines(spark):
    r = random.Random(12)
    texts = ["\n".join("".join(r.choices("abcdefghijklmnop", k=r.randint(1, 12))) for _ in range(8)) for _ in range(40)] + ["Les.\n a \nb", "And ornd.\nLes.\na"]
    lines = [(d, k, line.strip()) for d, t in enumerate(texts) for k, line in enumerate(t.split("\n"))]
    near = lambda x, y: x == y or (min(len(x), len(y)) >= 3 and levenshtein(x, y) <= 2)
    want = {(d, k) for n, (d, k, x) in enumerate(lines) if any(near(x, y) for _, _, y in lines[:n])}
    got = {(x.doc_id, k) for x in linededup.duplicates(docs(spark, texts)).collect() for k in x.removed}
    assert got == want and {(41, 1), (41, 2)} <= got and len(got) < len(lines)


def lines_by_hand(texts):
    lines = [(d, k, line.strip()) for d, t in enumerate(texts) for k, line in enumerate(t.split("\n"))]
    near = lambda x, y: x == y or (min(len(x), len(y)) >= 3 and abs(len(x) - len(y)) < 3 and levenshtein(x, y) <= 2)
    return {(d, k) for n, (d, k, x) in enumerate(lines) if any(near(x, y) for _, _, y in lines[:n])}


@pytest.mark.parametrize("frequent", [True, False])
def test_lines_of_frequent_keys(spark, monkeypatch, frequent):
    """Lines that share a segment, or two, or are a family, when every key is taken for one that makes too many pairs."""
    monkeypatch.setattr(linededup, "MOST_PAIRS", 3)
    monkeypatch.setattr(linededup, "BLOCK_LINES", 4)
    if frequent:
        monkeypatch.setattr(linededup, "SAMPLED", 1)
        monkeypatch.setattr(linededup, "LEAST_FREQUENT", 5)
    r = random.Random(15)
    any_ = lambda n: "".join(r.choices("abcdefgh", k=n))
    lines = ["common beginning " + any_(r.randint(8, 16)) for _ in range(60)] + [any_(14) + " and an end" for _ in range(30)]
    lines += [edited(r, x, r.randint(1, 3)) for x in r.sample(lines, 40)] + [f"record number {k:04d}" for k in range(0, 4000, 57)] + [any_(r.randint(3, 6)) for _ in range(20)]
    r.shuffle(lines)
    texts = ["\n".join(lines[k : k + 6]) for k in range(0, len(lines), 6)]
    got = {(x.doc_id, k) for x in linededup.duplicates(docs(spark, texts)).collect() for k in x.removed}
    assert got == lines_by_hand(texts)


def test_many_lines_of_one_key(spark):
    r = random.Random(16)
    lines = ["this segment is common to all " + "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=45)) for _ in range(10_000)]
    lines[5000], lines[9000] = lines[7] + "q", lines[8][:40] + lines[8][41:]
    got = {(x.doc_id, *x.removed) for x in linededup.duplicates(docs(spark, ["\n".join(lines[k : k + 100]) for k in range(0, 10_000, 100)])).collect()}
    assert got == {(50, 0), (90, 0)}


def test_lines_are_compared_whole(spark):
    a, b = thue_morse()
    assert linededup.duplicates(docs(spark, [a, b])).count() == 0 and spans.repeats(docs(spark, [a + " x" * 60, b + " x" * 60])).count() == 0
    assert [x.removed for x in linededup.duplicates(docs(spark, [a, b, a])).collect()] == [[0]]


def test_warc_links(spark):
    page = '<html><head><title> T &amp; x </title><script>no()</script></head><body><p>One &lt;b&gt;</p><a href="http://o/1">Two</a></body></html>'
    responses = warc.responses(spark.createDataFrame([(1, "http://a", page)], "page_id bigint, url string, html string"))
    source = responses.first()
    made = {r.warc_type: r for r in warc.derivatives(responses).collect()}
    meta, text = made["metadata"], made["conversion"]
    assert {meta.refers_to, text.refers_to} == {source.record_id} and meta.concurrent_to == text.record_id and text.concurrent_to == meta.record_id
    assert f"source-payload-digest: {source.payload_digest}" in meta.content and "outlink: http://o/1" in meta.content
    assert "source-http: HTTP/1.1 200 OK\r\nsource-http: Content-Type: text/html" in meta.content and "\r\ntitle: T & x\r\n" in meta.content
    assert text.content == "T & x\nOne <b>\nTwo"
    raw = bytes(warc.serialized(warc.derivatives(responses)).where(F.col("record_id") == text.record_id).first().record)
    head, _, body = raw.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    assert body[:size].decode() == text.content and body[size:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
    assert f"WARC-Refers-To: {source.record_id}".encode() in head


def test_warc_references(spark):
    import html

    same = "&amp;lt; &#x1F600; &#150;&#x96; &nosuch; &CounterClockwiseContourIntegral; a&b;&; &Tab;y&NewLine;z &notin; &not; &hellip;; &&amp;& " + " ".join(f"&{n}" for n in html.entities.html5 if n.endswith(";") and n not in ("nbsp;", "NonBreakingSpace;"))
    rows = [(same,), ("&#0; &#xD800; &#99999999; &amp &nbsp;&#160;.",), ("",), (None,)]
    got = [x[0] for x in spark.createDataFrame(rows, "s string").select(warc.decoded(F.col("s"))).collect()]
    assert got == [html.unescape(same), "&#0; &#xD800; &#99999999; &amp   .", "", None]


def test_histogram_sort(spark):
    r = random.Random(3)
    rows = [(r.choice((r.randrange(10**12), r.randrange(1000))), "x" * r.randrange(200)) for _ in range(3000)] + [(None, "y" * 50)] * 2
    got = histosort.sharded(docs(spark, rows), "doc_id", F.octet_length("text"), 20_000, 0.02)
    parts = got.withColumn("p", F.spark_partition_id()).collect()
    assert len(parts) == len(rows) and all(x.p == x.shard for x in parts)
    total = sum(len(t) for _, t in rows)
    n = -(-total // 20_000)
    sizes = [sum(x.n_bytes for x in parts if x.shard == k) for k in range(n)]
    assert sum(sizes) == total and max(abs(s - total / n) for s in sizes) <= 0.05 * total / n + 200
    assert [-1 if x.doc_id is None else x.doc_id for x in parts] == sorted(-1 if i is None else i for i, _ in rows)


@pytest.mark.parametrize("spread", [1, 10**13, 2**63 // 10**6])
def test_splitters_of_many_shards(spread):
    """100,000 shards of keys in hand; the ends of the range of keys too."""
    rng = np.random.default_rng(18)
    keys = np.sort(rng.integers(-(10**6), 10**6, 2_000_000) * spread)
    keys[:2], keys[-2:] = -(2**63), 2**63 - 1
    upto = np.concatenate(([0], np.cumsum(np.full(len(keys), 100))))
    got = histosort.search(lambda asked: upto[np.searchsorted(keys, asked)], int(keys[0]), int(keys[-1]), int(upto[-1]), 0, 2_000, 0.02, histosort.PROBES)
    edges = upto[np.concatenate(([0], np.searchsorted(keys, got), [len(keys)]))]
    heaviest = np.unique(keys, return_counts=True)[1].max() * 100
    assert np.diff(edges).max() <= 2_000 * 1.05 + heaviest and len(got) > 60_000
    few = histosort.search(lambda asked: upto[np.searchsorted(keys, asked)], int(keys[0]), int(keys[-1]), int(upto[-1]), 0, 2_000, 0.02, histosort.PROBES, most=10)
    assert len(few) == 9 and np.abs(upto[np.searchsorted(keys, few)] - upto[-1] * np.arange(1, 10) / 10).max() <= 0.02 * upto[-1] / 10 + heaviest


def test_decontamination(spark):
    r = random.Random(4)
    items = [prose(r, r.randint(3, 30)) for _ in range(20)] + ["Yes", "oak elm", "?"]
    texts = []
    for _ in range(60):
        t = prose(r, r.randint(0, 60))
        if r.random() < 0.5:
            t += ", " + r.choice(items).upper().replace(" ", r.choice(" \n")) + r.choice(("! ", "\n")) + prose(r, 5)
        texts.append(t)
    texts += ["Yes, but\n- yes!\nyes", "oak elm\noak elm fir\n(oak, elm)", "yes"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {x.doc_id: x for x in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    phrases = {}
    for k, item in enumerate(items):
        w = re.findall(r"\w+", item.lower())
        if w:
            n = min(len(w), decontaminate.WORDS)
            for j in range(len(w) - n + 1):
                phrases.setdefault(tuple(w[j : j + n]), set()).add(k)
    for d, t in enumerate(texts):
        places = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[A-Za-z]+", t)]
        hit, owners = [], set()
        for p, ks in phrases.items():
            for j in range(len(places) - len(p) + 1):
                a, b = places[j][0], places[j + len(p) - 1][1]
                alone = not re.search(r"\w", t[t.rfind("\n", 0, a) + 1 : a]) and not re.search(r"\w", t[b:].split("\n")[0])
                if tuple(x[2] for x in places[j : j + len(p)]) == p and (alone or len(p) >= decontaminate.LEAST):
                    hit.append((places[j][0], places[j + len(p) - 1][1]))
                    owners |= ks
        merged = []
        for a, b in sorted(hit):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        assert [[s.start, s.end] for s in got[d].spans] == merged if merged else d not in got
        if merged:
            assert got[d].item_ids == sorted(owners)
    clean = {x.doc_id: x.text for x in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    assert all(clean[d] == x.cleaned for d, x in got.items()) and len(clean) == len(texts)
    assert [[s.start, s.end] for s in got[60].spans] == [[11, 14], [16, 19]] and 62 in got


def test_secrets_held_out():
    words = secrets.dictionary("/opt/tokenizers/" + secrets.DICTIONARY)
    forest = secrets.train(secrets.seen(secrets.labelled_findings(words)), words)
    held, features = secrets.seen(secrets.labelled_findings(words, 1500, seed=77)), secrets.Features(words)
    score = forest(np.array([features(*x[:4]) for x in held]))
    label = np.array([x[4] for x in held])
    assert ((score >= 0.5) == label).mean() > 0.95
    assert (forest(np.zeros((2, len(secrets.FEATURES)))) <= 1).all()


def test_secrets_found(spark):
    key = "4f9c1a77e0b34d5588aa12cc90de6f3b1c2d4e5f"
    texts = [f'call token = "{key}" now', f"at commit {key} we", "see theinternationalizationofeverything here", 'password: "hunter2hunter2"']
    texts += ["DB_PASSWORD: Tr0ub4dor&3xyz", "secret: p@ssW0rd!9#kLmN$22xyz", "postgres://admin:s3cr3tPass9x@db.host/prod", "API_TOKEN=9fQ2xLmZ81kdPq0RtYw3 ok", "password: required", "x" * 50_000 + ' token="aB3dE5gH7jK9"' * 2000]
    got = {}
    for x in secrets.scan(docs(spark, texts)).collect():
        got.setdefault(x.doc_id, []).append((texts[x.doc_id][x.start : x.end], x.is_secret))
    assert got[0] == [(key, True)] and got[1] == [(key, False)] and not got[2][0][1]
    assert [got[k] for k in (4, 5, 6, 7)] == [[(x, True)] for x in ("Tr0ub4dor&3xyz", "p@ssW0rd!9#kLmN$22xyz", "s3cr3tPass9x", "9fQ2xLmZ81kdPq0RtYw3")]
    assert got[8] == [("required", False)] and len(got[9]) == 2001


def test_secrets_of_documents(spark):
    """The findings that the tables' documents hold, none of which was trained on: each token is a secret, and what else is one is rare."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    want = {(k, *m.span(1)) for k, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    got = {(r.doc_id, r.start, r.end) for r in secrets.scan(d).where("is_secret").collect()}
    assert len(want & got) >= 0.95 * len(want) > 0
    assert len(want & got) >= 0.9 * len(got)


def test_half_of_the_votes(spark):
    forest = secrets.Forest(np.zeros((10, len(secrets.FEATURES))), np.array([0.0, 1.0] * 5), trees=1)
    forest.trees = [(np.array([-1]), np.array([0.0]), np.array([-1]), np.array([-1]), np.array([0.5]))]
    assert (forest(np.zeros((1, len(secrets.FEATURES)))) >= 0.5).all()


def test_secrets_given_labels(spark):
    rows = [("a" * 20, "p", "", "", 0)] * 5
    one = spark.createDataFrame(rows, "candidate string, path string, before string, after string, label int")
    d = docs(spark, ["x " + "a" * 20])
    assert [x.is_secret for x in secrets.scan(d, one).collect()] == [False]
    assert [x.is_secret for x in secrets.scan(d, one.limit(0)).collect()] == [True]


def test_outliers(spark):
    r = random.Random(5)
    good = [(k, ". ".join(prose(r, 12).capitalize() for _ in range(8)) + ".", "en" if k % 2 else "de", f"s{k % 3}") for k in range(600)]
    bad = [(1000 + k, "".join(r.choices("#$%&*!@ 0123456789", k=600)), "en", "s1") for k in range(30)]
    got = {x.doc_id: x.rejected for x in outliers.outliers(docs(spark, good + bad)).collect()}
    assert all(got[k] for k, *_ in bad)
    assert sum(got[k] for k, *_ in good) <= 6


def test_covariance_determinant_exhaustively(spark):
    """The least determinant over all subsets of 12 of 16 vectors, where medians alone lead elsewhere; ties and a constant group."""
    from itertools import combinations

    rng = np.random.default_rng(21)
    factor, rows, want = outliers._consistency(0.75), [], {}
    for k in range(8):
        x = rng.normal(0.5, 0.1, (16, outliers.P))
        x[12:] += rng.normal(0.6, 0.05, (4, outliers.P)) * (k % 4) / 3
        if k == 7:
            x[:] = x[0]
        rows += [(str(k), *map(float, v)) for v in x]
        want[str(k)] = min(outliers._covariance(x[list(c)], np.ones(12), factor)[2] for c in combinations(range(16), 12))
    points = spark.createDataFrame(rows, ", ".join(["g string", *(f"{c} double" for c in outliers.X)]))
    got = {x.g: x.logdet for x in outliers.estimates(points).collect()}
    assert set(got) == set(want)
    assert all(got[g] < want[g] + 0.05 for g in want) and all(got[g] > want[g] - 0.05 for g in want), [(g, got[g], want[g]) for g in want]


def test_outlier_groups(spark):
    """A group of 50 documents has its own estimates, one of 49 those of its language."""
    rows = [(k, prose(random.Random(k), 30), "en", "a" if k < 50 else "b") for k in range(99)]
    got = outliers.grouped(outliers.statistics(docs(spark, rows), ["doc_id", "lang", "source"])).select("source", "g").distinct().collect()
    assert {x.source: x.g for x in got} == {"a": "=en\x1f=a", "b": "=en"}


def test_outliers_counts():
    got = dict(zip(outliers.COUNTS, outliers.counts_of(["Ab c1 ab c1 ab\nxy\nxy", None])[0].tolist()))
    assert got == {"solid": 14, "letters": 12, "capitals": 1, "numbers": 2, "words": 7, "again": 1, "rows": 3, "same": 1}


def test_chi2():
    assert outliers.chi2_quantile(0.95, 6) == pytest.approx(12.5916, abs=1e-3)


def test_language_held_out(spark):
    r = random.Random(6)
    en, de = EN.split(), DE.split()
    rows = [(k, " ".join(r.choices(en if k % 2 else de, k=30)), "en" if k % 2 else "de") for k in range(200)]
    rows += [(1000 + k, " ".join(r.choices(en if k % 2 else de, k=20)), None) for k in range(100)]
    got = {x.doc_id: x for x in language.predict(docs(spark, rows)).collect()}
    assert sum(got[1000 + k].predicted_lang == ("en" if k % 2 else "de") for k in range(100)) >= 98
    foreign = language.predict(docs(spark, rows + [(5000, "Съешь же ещё этих мягких французских булок да выпей чаю", None)])).where("doc_id = 5000").first()
    assert not foreign.accepted


def test_language_rejects_other_latin(spark):
    r = random.Random(14)
    en, de = EN.split(), DE.split()
    rows = [(k, " ".join(r.choices(en if k % 2 else de, k=r.randint(5, 60))), "en" if k % 2 else "de") for k in range(300)]
    clean = [(1000 + k, " ".join(r.choices(en if k % 2 else de, k=r.randint(2, 40))), None) for k in range(200)]
    foreign = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita",
        "Mieleni minun tekevi, aivoni ajattelevi, sanat suussani sulavat, puheet putoelevat",
        "Litwo, Ojczyzno moja! ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie",
        *(" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(30)) for _ in range(10)),
        *("".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=200)) for _ in range(10)),
    ]
    got = {x.doc_id: x.accepted for x in language.predict(docs(spark, rows + clean + [(5000 + k, t, None) for k, t in enumerate(foreign)])).collect()}
    assert not any(got[5000 + k] for k in range(len(foreign)))
    assert sum(got[k] for k, *_ in clean) >= 190


def test_spectrum_by_hand():
    r = random.Random(19)
    texts = ["abc", "abd", "xyz", "", None, "漢字かな交じり文 漢字", "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(3000)), EN * 50]
    got = [set(g.tolist()) for g in language.Spectrum()(texts)]
    want = [{t[a : a + n] for n in (1, 2, 3) for a in range(len(t) - n + 1)} for t in ((x or "").lower() for x in texts)]
    number = lambda g: sum((ord(c) + 1) << 21 * k for k, c in enumerate(reversed(g)))
    assert got == [{number(g) for g in w} for w in want]
    known = np.unique(np.array([number(g) for w in want[:7:2] for g in w], np.int64))
    asked = np.array([number(g) for w in want for g in w], np.int64)
    place = language.Known(known)(asked)
    assert all((known[p] == g) if p >= 0 else g not in known for p, g in zip(place, asked))


def test_language_against_dense_ridge():
    """Scores against dense matrices over all n-grams, and verdicts with equal scores."""
    r = random.Random(20)
    en, de = EN.split(), DE.split()
    rows = [("en" if k % 2 else "de", " ".join(r.choices(en if k % 2 else de, k=r.randint(4, 20)))) for k in range(80)]
    asked = [" ".join(r.choices(en + de, k=12)) for _ in range(30)] + ["", "漢字"]
    spectrum = lambda t: {t[a : a + n] for n in (1, 2, 3) for a in range(len(t) - n + 1)}
    kernel = lambda x, y: np.array([[len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b))) for b in y] for a in x])
    train, test = [spectrum(t.lower()) for _, t in rows], [spectrum(t.lower()) for t in asked]
    marks = [train[k] for lang in ("de", "en") for k in [k for k, (x, _) in enumerate(rows) if x == lang][:10]]
    own, vectors = np.linalg.eigh(kernel(marks, marks))
    root = vectors / np.sqrt(own)
    z = kernel(train, marks) @ root
    y = np.array([[1.0 if x == lang else -1.0 for lang in ("de", "en")] for x, _ in rows])
    want = kernel(test, marks) @ root @ np.linalg.solve(z.T @ z + 0.01 * np.eye(20), z.T @ y)
    scorer = language.Scorer(language.fit(rows, landmarks=10, ridge=0.01, held=False))
    scores, share, grams = scorer(asked)
    assert np.allclose(scores, want, atol=1e-5)
    known = set().union(*marks)
    assert np.allclose(share, [len(t & known) / max(1, len(t)) for t in test]) and grams.tolist() == [len(t) for t in test]
    lang, top, lead, ok = language.verdicts(np.array([[0.5, 0.5], [0.1, 0.9]]), np.ones(2), np.array([9, 9]), ["ab", "ab"], ["de", "en"], {}, 0.2, 0.0)
    assert lang == ["de", "en"] and ok.tolist() == [False, True]


def thue_morse():
    """Two pieces that differ everywhere and that polynomials of any odd base modulo a power of two can't tell apart."""
    a = "a"
    for _ in range(12):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_suffix_automaton():
    tokens = [b"a", b"b", b"c", b"ab", b"abc", b"cab", b"bcab", b"bb", b"abab"]
    follow, link, length, state_of = bpe.suffix_automaton(tokens)
    inside = {t[a:b] for t in tokens for a in range(len(t)) for b in range(a + 1, len(t) + 1)}

    def walk(x):
        s = 0
        for c in x:
            s = follow[s].get(c, -1)
            if s < 0:
                return -1
        return s

    from itertools import product

    for n in (1, 2, 3, 4, 5):
        for x in map(bytes, product(b"abc", repeat=n)):
            assert (walk(x) >= 0) == (x in inside)
            if x in inside:
                assert length[link[walk(x)]] < n <= length[walk(x)]
    assert state_of == [walk(t) for t in tokens]


def test_bpe_equals_merging(spark):
    import tiktoken

    tokens = bpe.load_tokens("/opt/tokenizers/" + bpe.VOCABULARY)
    r = random.Random(7)
    texts = ["".join(r.choices("ab the ing tion 's'll  \n\t123éß漢😀!?-_", k=r.randint(0, 300))) for _ in range(300)] + [None, "", "a" * 5000, "".join(r.choices("etaoinshrdlu", k=3000)), "漢字かな交じり文" * 200, *thue_morse(), " " * 3000, "it's they'll I'VE  x"]
    pattern = __import__("public_tokenizers").PATTERN
    real = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    d = docs(spark, list(enumerate(texts)))
    got = {x.doc_id: x for x in bpe.encode(d).collect()}
    for k, t in enumerate(texts):
        if t is None:
            assert got[k].token_ids is None
        else:
            assert got[k].token_ids == real.encode_ordinary(t), t
            assert got[k].round_trip
    back = {x.doc_id: x.text for x in bpe.decode(bpe.encode(d)).collect()}
    assert [back[k] for k in range(len(texts))] == texts


def test_spans(spark):
    r = random.Random(8)
    shared = [prose(r, 10).capitalize() + "." for _ in range(8)]
    texts = []
    for _ in range(40):
        own = [prose(r, 10).capitalize() + "." for _ in range(4)]
        if r.random() < 0.5:
            a = r.randrange(6)
            own[2:2] = shared[a : a + r.randint(2, 6)]
        texts.append(" ".join(own))
    seen, want = {}, {}
    for d, t in enumerate(texts):
        s = [x.lower() for x in re.findall(r"[^.]+\.", t)]
        s = [x.strip() for x in s]
        for k in range(len(s) - spans.RUN + 1):
            run = tuple(s[k : k + spans.RUN])
            if seen.setdefault(run, (d, k)) != (d, k):
                want.setdefault(d, set()).update(range(k, k + spans.RUN))
    got = {x.doc_id: set(x.removed) for x in spans.repeats(docs(spark, texts)).collect()}
    assert got == want and want
    for x in spans.changed(docs(spark, texts)).collect():
        s = [y.strip() for y in re.findall(r"[^.]+\.", texts[x.doc_id])]
        assert x.text == " ".join(y for k, y in enumerate(s) if k not in want[x.doc_id])


def test_spans_of_short_and_long_sentences(spark):
    r = random.Random(13)
    poem, long = "\n".join(r.sample(WORDS, 23)), prose(r, 80)
    own = ["%s %s. %s %s." % tuple(r.sample(WORDS, 4)) for _ in range(2)]
    # the passage of 10, 8, 12 and 6 words ends with a run of less than 20 in two sentences
    passage = " ".join(prose(r, k).capitalize() + "." for k in (10, 8, 12, 6))
    texts = [poem, poem, long, long, own[0] + " " + long + ".", own[1] + " " + long + ".", "Fir. " + passage + " Elm.", "Oak. " + passage + " Yew.", "ash birch", "ash birch", prose(r, 24), "x"]
    texts[11] = texts[10]
    got = {x.doc_id: list(x.removed) for x in spans.repeats(docs(spark, texts)).collect()}
    assert got == {1: list(range(23)), 3: [0], 5: [2], 7: [1, 2, 3, 4], 11: [0]}


def test_one_passage_in_many_documents(spark):
    r = random.Random(17)
    passage = " ".join(prose(r, 12).capitalize() + "." for _ in range(3))
    texts = [f"Number {k} {prose(r, 9)}. {passage} End {k} {prose(r, 9)}." for k in range(10_000)]
    got = {x.doc_id: x.removed for x in spans.repeats(docs(spark, texts)).collect()}
    assert len(got) == 9_999 and 0 not in got and all(x == [1, 2, 3] for x in got.values())


def near_by_hand(rows, distance):
    return {(min(a, b), max(a, b)) for n, (a, x) in enumerate(rows) for b, y in rows[:n] if (x ^ y).bit_count() <= distance}


@pytest.mark.parametrize("distance, rows_of_block", [(1, None), (3, None), (7, 10), (13, None), (simhash.DISTANCE, None), (simhash.DISTANCE, 7)])
def test_near_signatures(spark, monkeypatch, distance, rows_of_block):
    if rows_of_block:
        monkeypatch.setattr(simhash, "ROUTE_ROWS", rows_of_block)
    r = random.Random(distance)
    rows = []
    for k in range(60):
        base = r.getrandbits(128)
        rows.append((10 * k, base))
        for j in range(1, 6):
            rows.append((10 * k + j, base ^ sum(1 << p for p in r.sample(range(128), r.randint(1, distance + 2)))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(x & ((1 << 64) - 1)), signed(x >> 64)) for i, x in rows], "id bigint, hi bigint, lo bigint")
    got = [(x.a, x.b) for x in simhash.near_signatures(df, distance).collect()]
    assert len(got) == len(set(got)) and set(got) == near_by_hand(rows, distance)


def test_near_signatures_that_come_together_in_hundreds(spark):
    """Groups of values and tiles, all pairs and spanning ones."""
    r = np.random.default_rng(3)
    bits = np.concatenate([r.random((1500, 64)) < 0.1, r.random((1500, 64)) < 0.17], axis=1)
    halves = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    df = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(halves)], "id bigint, hi bigint, lo bigint")
    want = near_by_hand([(k, int.from_bytes(x.tobytes(), "little")) for k, x in enumerate(halves)], 17)
    got = [(x.a, x.b) for x in simhash.near_signatures(df, 17).collect()]
    assert len(want) > 1500 and len(got) == len(set(got)) and set(got) == want
    spanning = simhash.near_signatures(df, 17, spanning=True)
    assert spanning.count() < len(want)
    assert {tuple(x) for x in components(spanning).collect()} == {tuple(x) for x in components(spark.createDataFrame(sorted(want), "a bigint, b bigint")).collect()}


def test_many_copies_that_all_differ(spark, monkeypatch):
    """1,000 near copies of a text give about as many pairs to the components, not half a million."""
    seen = []
    monkeypatch.setattr(simhash, "components", lambda pairs: seen.append(pairs.count()) or components(pairs))
    r = random.Random(23)
    base = [prose(r, 1) + str(k) for k in range(400)]
    texts = [" ".join(base[:j] + [f"own{k}"] + base[j + 1 :]) for k in range(1000) for j in [r.randrange(400)]]
    got = simhash.groups(docs(spark, texts)).collect()
    assert len(got) == 1000 and {(x.group_id, x.group_size) for x in got} == {(0, 1000)}
    assert seen[0] <= 4 * 1000


def test_signatures_by_hand():
    """Signs of weighted sums over distinct words, ties included."""
    from plumbline.llm import textnum as tn

    texts = ["oak oak elm", "elm! ash", "x", "...", "Fir fir FIR oak yew", None]
    rows, halves = simhash.signatures_of(texts)
    assert rows.tolist() == [0, 1, 2, 4]
    for r, got in zip(rows, halves.view(np.uint64)):
        words = re.findall(r"\w+", texts[r].lower())
        want = [0, 0]
        total = {}
        for w in set(words):
            h = tn.words([w])[3] >> np.uint64(24)
            weight = np.float32(words.count(w) ** 0.25)
            for half in (0, 1):
                bits = int(tn.mix(h, half + 1)[0])
                for b in range(64):
                    total[half, b] = total.get((half, b), 0) + (weight if bits >> b & 1 else -weight)
        for (half, b), x in total.items():
            want[half] |= int(x >= -1e-6) << b
        assert got.tolist() == want


def test_signatures_with_ties():
    """Equal weights on both sides give 1, in whatever order they are added up."""
    from plumbline.llm import textnum as tn

    r = random.Random(29)
    texts, counts = [], []
    for _ in range(300):
        counts.append({f"w{r.randrange(10**6)}": c for c in 2 * [r.randint(2, 5) for _ in range(r.randint(2, 5))]})
        texts.append(" ".join(w for w, c in counts[-1].items() for _ in range(c)))
    rows, halves = simhash.signatures_of(texts)
    assert rows.tolist() == list(range(300))
    for own, got in zip(counts, halves.view(np.uint64).tolist()):
        hashes = {w: tn.words([w])[3] >> np.uint64(24) for w in own}
        mixed = {w: [int(tn.mix(h, half)[0]) for half in (1, 2)] for w, h in hashes.items()}
        for half in (0, 1):
            for b in range(64):
                ones, zeros = (sorted(c for w, c in own.items() if (mixed[w][half] >> b & 1) == side) for side in (1, 0))
                want = ones == zeros or sum(c**0.25 for c in ones) > sum(c**0.25 for c in zeros)
                assert got[half] >> b & 1 == want


def test_simhash_groups(spark):
    r = random.Random(9)
    base = [prose(r, 12) + " " + " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(10)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, t) for k, t in enumerate(base[:5])] + [(200 + k, t.upper() + "!") for k, t in enumerate(base[:3])]
    got = {x.doc_id: (x.group_id, x.group_size, x.keep) for x in simhash.groups(docs(spark, rows)).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 100, 101, 102, 103, 104, 200, 201, 202}
    assert got[0] == (0, 3, True) and got[200] == (0, 3, False) and got[104] == (4, 2, False)
    assert simhash.deduplicated(docs(spark, rows)).count() == 10


def test_components(spark):
    pairs = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (7, 7)]
    got = {x.id: x.least for x in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert all(got[k] == 0 for k in range(51)) and got[101] == 100
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sieve(spark):
    from plumbline.llm.common import passes, sieve

    rng = np.random.default_rng(23)
    ids, others = (rng.integers(-(2**63), 2**63 - 1, 3000) for _ in range(2))
    bits = sieve(spark.createDataFrame([(int(x),) for x in ids], "id bigint"))
    assert passes(bits, ids).all() and passes(bits, others).mean() < 0.2
    assert not passes(sieve(spark.createDataFrame([], "id bigint")), others).any()
