"""Operators against plain versions, on texts with nulls, empties, ties, copies and odd columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, decontaminate, licenses, lines, packing, quality, queries, simhash, substrings, tokens, urls, warc
from quillon.llm.components import components
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, lines string, quality int, key string, row string"


def corpus():
    r = random.Random(7)
    word = lambda: "".join(r.choice(["an", "re", "to", "ß", "É", "le", "of", "x"]) for _ in range(r.randint(1, 3)))
    line = lambda n: " ".join(word() for _ in range(n))
    common, passage = "A  common LINE", line(30)
    texts = [None, "", " ", "\n\n", "x", "GNU General Public License, MIT  license; CC-BY cc by", "a b c d e f g h i j " * 3]
    texts += ["\n".join(line(r.randint(3, 14)) for _ in range(r.randint(1, 6))) for _ in range(40)]
    texts += [f"{line(5)}\n {common.lower() if i % 2 else common} \n{line(4)}" for i in range(12)]
    texts += [line(8) + " " + passage + " " + line(8) for _ in range(6)]
    base = line(120)
    for i in range(8):
        w = base.split(" ")
        w[i * 9] = word()
        texts.append(" ".join(w))
    twice = line(25)
    texts += [twice + "\n" + line(9), f"{line(4)} {twice} {line(6)} {twice} {line(3)} {twice}", f"{line(7)} {twice}\n{line(2)} {twice}"]
    texts += [base] * 4 + ["tail\n" + base + "\x00\x01" + base, line(4000), "<|endoftext|> and  \n two", "日本語 " * 20]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 3 else "en", "s", len(t or ""), "l", 1, "k", "r") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: (r[0] is None, r))


def test_licenses(docs, texts, empty):
    got = rows(licenses.license_scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == [(i, *brute.licenses(t)) for i, t in texts]
    assert licenses.license_scan(empty).count() == 0


def test_license_templates():
    m = licenses.Automaton()
    m.add("a", "<<beginOptional>>the <<beginOptional>>big <<endOptional>><<endOptional>>MIT <<var;match=.{1,2}>> end")
    m = m.ready()
    scan = lambda t: m.scan(licenses.words_of(t.encode()))
    assert scan("The BIG mit x end") == [("a", 0, 5), ("a", 2, 5)]
    assert scan("mit x y end") == [("a", 0, 4)] and scan("mit end") == [] and scan("mit x y z end") == []
    assert scan("mit other") == []
    with pytest.raises(ValueError, match="not closed"):
        licenses.Automaton().add("b", "<<beginOptional>>x")
    with pytest.raises(ValueError, match="didn't begin"):
        licenses.Automaton().add("b", "x <<endOptional>>")
    for pattern in ("[a-z]+", ".{3,1}", ".?", "(a|b)"):
        with pytest.raises(ValueError):
            licenses.Automaton().add("b", f"x <<var;match={pattern}>> y")


def test_license_labels_and_scores(spark):
    """Random texts of the templates' words, and the templates themselves, against regular expressions over words."""
    r = random.Random(12)
    own = {
        "one": "free <<var;match=.{0,2}>> software <<beginOptional>>of <<beginOptional>>the <<endOptional>><<var;match=mit|gnu project>><<endOptional>> here",
        "loop": "begin <<var;match=.+>> end", "any": "open <<var;match=.*>> shut", "two": "<<beginOptional>>the <<endOptional>>software",
    }
    words = ["free", "software", "of", "the", "mit", "gnu", "project", "here", "begin", "end", "open", "shut", "x"]
    given = [" ".join(r.choices(words, k=r.randint(0, 14))) for _ in range(250)] + [None, "", "MIT License mit license", "the, SOFTWARE; the software"]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id bigint, text string").repartition(3)
    got = rows(licenses.license_scan(df.unionByName(df), templates=own), "doc_id", "labels", "score", "n_notices")
    want = [(i, *brute.license_matches(t, licenses.PHRASES, own)) for i, t in enumerate(given)]
    assert got == sorted(want * 2)


def test_whole_license_texts():
    m = licenses._machine(tuple(licenses.PHRASES.items()), tuple(licenses.TEMPLATES.items()))
    fill = {"match=.{1,6}": "software and associated documentation files", "match=.{2,12}": "the authors or copyright holders", "match=.{2,14}": "the copyright holders and contributors"}

    def text(template, optional):
        t = template
        while "<<beginOptional>>" in t:  # innermost regions first
            at = t.rindex("<<beginOptional>>")
            end = t.index("<<endOptional>>", at)
            t = t[:at] + (t[at + 17 : end] if optional else "") + t[end + 15 :]
        return re.sub(r"<<var;(.*?)>>", lambda x: fill.get(x[1]) or (x[1][6:].split("|")[0] if "{" not in x[1] else "w " * int(x[1][8:].split(",")[0])), t)

    for label, template in licenses.TEMPLATES.items():
        for optional in (False, True):
            words = licenses.words_of(text(template, optional).encode())
            assert (label, 0, len(words)) in m.scan(words), label
            if not optional:  # every word is mandatory, or one of a region's wordings
                assert label not in {x for x, i, _ in m.scan([b"other", *words[1:]]) if i == 0}
                assert label not in {x for x, _, _ in m.scan(words[:3] + [b"other"] + words[3:])} or "match=" in template, label


def test_quality(docs, texts, empty):
    field = quality.PLAIN
    got = rows(quality.quality(docs, field).select("doc_id", "quality.*"), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == [(i, *brute.quality(t)) for i, t in texts]
    assert quality.quality(empty, field).columns == [c for c in docs.columns if c != "quality"] + ["quality"]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    field = quality.LineField(np.zeros((1, 2)), rng.normal(size=(2, 2)), np.zeros(1), np.ones(1))
    docs = [rng.normal(size=(n, 2)) for n in (1, 4, 2, 6)]
    for scores, states in zip(docs, field.decode(docs), strict=True):
        value = lambda s, e=scores: sum(e[i, x] for i, x in enumerate(s)) + sum(field.transition[a, b] for a, b in zip(s, s[1:], strict=False))
        every = [tuple(k >> i & 1 for i in range(len(scores))) for k in range(2 ** len(scores))]
        assert value(tuple(states)) == pytest.approx(max(map(value, every)))


def test_verdicts_follow_the_best_path(docs, texts):
    """kept and content_share against every labelling of the lines of short texts."""
    rng = np.random.default_rng(5)
    n = quality.N_FEATURES - 1
    field = quality.LineField(rng.normal(size=(n, 2)), rng.normal(size=(2, 2)), np.zeros(n), np.ones(n))
    got = {r.doc_id: r.quality for r in quality.quality(docs, field).select("doc_id", "quality").collect()}
    tried = 0
    for i, t in texts:
        lines_ = (t or "").split("\n")
        if len(lines_) > 8:
            continue
        f = quality.line_features((t or "").encode())
        e = f[:, 1:] @ field.emission
        value = lambda p, e=e: sum(e[k, x] for k, x in enumerate(p)) + sum(field.transition[a, b] for a, b in zip(p, p[1:], strict=False))
        best = max(([k >> j & 1 for j in range(len(lines_))] for k in range(2 ** len(lines_))), key=value)
        chars = [len("".join(x.split(None))) if x.isascii() else len(re.findall(r"[^\x20\x09-\x0d]", x)) for x in lines_]
        share = sum(c for c, x in zip(chars, best, strict=True) if x) / sum(chars) if sum(chars) else 0.0
        q = got[i]
        assert q.content_share == pytest.approx(share) and q.content_lines == sum(best) and q.n_lines == len(lines_)
        assert q.kept == (not q.base_failed and share >= 0.5)
        tried += 1
    assert tried > 40


def test_field_gradient():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(3, 4, 2)), rng.integers(0, 2, (3, 4))
    mask = np.arange(4)[None] < np.array([4, 2, 1])[:, None]
    e, t, w = rng.normal(size=(2, 2)), rng.normal(size=(2, 2)), np.ones(3)

    def value(e, t):
        total = 0
        for k in range(3):
            n = mask[k].sum()
            s = lambda p, k=k: sum(x[k, i] @ e[:, v] for i, v in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False))
            total += s(y[k, :n]) - np.log(sum(np.exp(s([j >> i & 1 for i in range(n)])) for j in range(2**n)))
        return total / 3

    ge, gt = quality._gradients(e, t, x, y, mask, w)
    for g, a in ((ge, 0), (gt, 1)):
        for i in np.ndindex(2, 2):
            step = np.zeros((2, 2))
            step[i] = 1e-6
            args = [e, t]
            args[a] = args[a] + step
            assert g[i] == pytest.approx((value(*args) - value(e, t)) / 1e-6, abs=1e-4)


def test_quality_of_held_out_documents(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    field = quality.train(docs, labels.where("doc_id % 2 = 0"))
    got = quality.quality(docs, field).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("good")), "doc_id")
    right = got.where("not quality.base_failed").agg(F.avg((F.col("quality.kept") == (F.col("good") == 1)).cast("double"))).first()[0]
    assert right > 0.9


@pytest.fixture(scope="module")
def model():
    return bpe.load(queries.tokenizer())


def encode(model, t):
    return model.library.encode(t or "", add_special_tokens=False).ids


def test_token_counts(docs, texts, empty, model):
    table = tokens.prefix_table(docs, queries.tokenizer())
    got = rows(tokens.within_budget(table, 20), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == [(i, len((t or "").encode()), len(encode(model, t)), len(encode(model, t)) > 20) for i, t in texts]
    assert tokens.within_budget(tokens.prefix_table(empty, queries.tokenizer()), 5).count() == 0
    cut = {r.doc_id: r.text for r in tokens.truncate(docs, table, 7).collect()}
    for i, t in texts:
        if t is not None:
            assert t.startswith(cut[i]) and len(encode(model, cut[i])) <= 7
            assert len(t) == len(cut[i]) or len(encode(model, t[: len(cut[i]) + 1])) > 7


def test_every_prefix_has_the_librarys_count(model):
    r = random.Random(1)
    bits = ["the", "ing", "'ll", "'re", "'s", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "12", "!!", "<|endoftext|>", "<|", "日", "😀", "xxxxx", "\r\n", "'", "'l"]
    for _ in range(150):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        counts = tokens.prefix_counts(tokens.pack_prefixes(next(model.deltas([t]))))
        assert counts.tolist() == [len(encode(model, t[:i])) for i in range(len(t) + 1)]
        assert np.frombuffer(model.ids(t), "<u4").tolist() == encode(model, t)


def test_long_and_many_chunks_have_the_librarys_count(model, monkeypatch):
    """Several tables and parts, pre-tokens over the tables' width, and tokens longer than that."""
    monkeypatch.setattr(bpe, "PART", 200)
    monkeypatch.setattr(bpe, "ROWS", 16)
    r = random.Random(2)
    given = ["".join(r.choice("abcdeéß ' ") for _ in range(r.randint(0, 90))) for _ in range(40)]
    given += ["x" * 120, " " * 100 + "y", "ä" * 60, "-" * 90, "we'll" * 9, "a\x1cb \x85c", ""]
    for t, d in zip(given, model.deltas(given), strict=True):
        assert tokens.prefix_counts(tokens.pack_prefixes(d)).tolist() == [len(encode(model, t[:i])) for i in range(len(t) + 1)]


def test_only_tokenizers_of_the_known_kind(tmp_path):
    import json

    with open(queries.tokenizer(), encoding="utf-8") as f:
        said = json.load(f)
    said["pre_tokenizer"] = {"type": "Whitespace"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said), encoding="utf-8")
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Bpe(str(path))


def test_near_duplicates(docs, texts, empty):
    got = simhash.near_duplicates(docs)
    fps = [(i, brute.fingerprint(t)) for i, t in texts]
    want = brute.near_components(fps)
    assert [(r[0], r[1] % 2**64, r[2]) for r in rows(got, "doc_id", "fp", "component_id")] == [(i, f, c) for (i, f), c in zip(fps, want, strict=True)]
    assert simhash.near_duplicates(empty).count() == 0


def test_jaccard_near_copies(spark, docs, texts, empty):
    """Links on both sides of 0.8; chains whose least class is no hub; copies in many fingerprint bits; a group that all but links."""
    r = random.Random(11)
    more = list(texts)
    for base_size, edits in ((46, 1), (60, 2), (100, 2), (220, 5), (900, 30)):
        base = [f"v{r.randrange(5000)}" for _ in range(base_size)]
        for _ in range(12):
            w = list(base)
            for at in r.sample(range(base_size), edits):
                w[at] = f"e{r.randrange(10**6)}"
            more.append((len(more), " ".join(w)))
    w = [f"c{r.randrange(5000)}" for _ in range(120)]
    for k in range(30):  # each a neighbour of the last
        w = w[2:] + [f"c{r.randrange(5000)}" for _ in range(2)]
        more.append((len(more), " ".join(w)))
    df = spark.createDataFrame(more, "doc_id bigint, text string").repartition(3)
    assert [c for _, c in rows(simhash.near_copies(df), "doc_id", "component_id")] == brute.jaccard_components(more)
    assert simhash.near_copies(empty).count() == 0


def test_pipeline_stage_drops_near_copies(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(5)
    texts = []
    for _ in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(150)]
        near = list(base)
        for at in r.sample(range(150), 2):
            near[at] = "other"
        texts += [base, near]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    assert [i for i, in rows(pipeline.near_dedup(spark, df, ""), "doc_id")] == list(range(0, 80, 2))


def test_links_in_deep_tries(spark, monkeypatch):
    """A node bound of few fingerprints makes the tables' traversal go down many levels."""
    monkeypatch.setattr(simhash, "NODE", 8)
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(5)})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp bigint")
    tied = {x.node % 2**64: x.root % 2**64 for x in components(simhash.links(df)).collect()}
    want = brute.near_components(list(zip(range(len(fps)), fps, strict=True)))
    groups = {}
    for f, c in zip(fps, want, strict=True):
        groups.setdefault(c, set()).add(tied.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_null_ids_in_near_duplicates(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "q r s t u"), (7, None), (3, "")], "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(None, 5), (5, 5), (None, None), (7, 3), (3, 3)}


def test_packing(docs, texts, empty, model):
    got = packing.pack(packing.pieces(docs, queries.tokenizer(), 1024, 2), 1024)
    found = got.collect()
    want = {(i, *p) for i, t in texts for p in brute.pieces(encode(model, t))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == want and len(found) == len(want)
    assert brute.gapless([(r.sequence_id, r.offset, r.length) for r in found])
    total = sum(r.length for r in found)
    assert len({r.sequence_id for r in found}) <= -(-total // 1024) + 1
    twice = packing.pack(packing.pieces(docs.where("doc_id < 9").unionByName(docs.where("doc_id < 9").withColumn("doc_id", F.lit(None).cast("bigint"))), queries.tokenizer(), 1024, 2), 1024).collect()
    assert len(twice) == 18 and brute.gapless([(r.sequence_id, r.offset, r.length) for r in twice])
    assert packing.pack(packing.pieces(empty, queries.tokenizer(), 1024, 2), 1024).count() == 0


def valid(people, sizes, capacity):
    return all(len(p) == len(sizes) and np.bincount(p, sizes).max() <= capacity and (np.bincount(p) > 0).all() for p in people)


def test_islands_improve_on_best_fit():
    """On sizes for which best fit wastes sequences the islands need fewer, by crossover and mutation alike."""
    saved = 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        sizes = np.sort(rng.integers(150, 500, 160))[::-1]
        first = packing._pack(sizes.tolist(), range(len(sizes)), 1000)
        people = packing.evolve([], sizes, 1000, seed, packing.GENERATIONS, packing.POPULATION)
        assert valid(people, sizes, 1000)
        won = packing._fitness(people[0], sizes, 1000)
        assert won >= packing._fitness(first, sizes, 1000)
        saved += -won[0] < first.max() + 1
        child = packing.crossover(people[0], people[-1], sizes, 1000, rng)
        assert valid([child, packing.mutate(child, sizes, 1000, rng, 5, 9)], sizes, 1000)
    assert saved >= 4


def test_bins_are_filled_as_full_as_can_be():
    r = random.Random(9)
    for _ in range(30):
        sizes, room = [r.randint(1, 40) for _ in range(r.randint(0, 9))], r.randint(0, 90)
        own = packing._fullest(sizes, room)
        sums = {sum(x for k, x in enumerate(sizes) if m >> k & 1) for m in range(2 ** len(sizes))}
        assert len(set(own)) == len(own) and sum(sizes[k] for k in own) == max(x for x in sums if x <= room)


def test_documents_need_fewer_sequences_than_best_fit(spark, data):
    cut = packing.pieces(spark.read.parquet(f"{data}/documents.parquet"), queries.tokenizer(), 1024, 2).cache()
    short = sorted((r.length for r in cut.where("length < 1024").collect()), reverse=True)
    plain = int(packing._pack(short, range(len(short)), 1024).max()) + 1
    found = packing.pack(cut, 1024).where("length < 1024").select("sequence_id").distinct().count()
    assert -(-sum(short) // 1024) <= found <= plain


def test_url_filter(spark):
    urls_ = [None, "", "no scheme", "http://", "http://Example.ORG/es/1?x", "https://a.example.org/en/1#t", "http://b.org", "http://x.com/de/5", "ftp://x.com/fr/://y", "http://x.net/a?b"]
    pages = spark.createDataFrame([(i, u, "c", 1) for i, u in enumerate([*urls_, urls_[-1]])], "page_id bigint, url string, host string, rule int")
    bad = spark.createDataFrame([(9, 1), (4, 0), (5, None), (10, 1)], "page_id bigint, bad int")
    got = urls.url_filter(pages, bad)
    for r in got.collect():
        host, path, best = brute.url(([*urls_, urls_[-1]])[r.page_id], urls.RULES)
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == (best[1] if best else "block" if r.bound > 0.2 else "allow")
    assert got.count() == 11
    assert urls.url_filter(pages.where("false"), bad.where("false")).count() == 0


def test_outcomes_of_pages_that_end_in_html(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    urls_ = [f"http://bad.net/p/{i}.html" for i in range(60)] + [f"http://good.net/p/{i}/" for i in range(60, 90)] + [f"http://good.net/{i}" for i in range(90, 120)]
    urls_ += ["http://bad.net/p/3xhtml", "http://bad.net/p/4.htm", "http://bad.net/p/\\\\xhtml", "http://bad.net/"]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "doc_id bigint, quality int")
    assert rows(queries.page_outcomes(pages, labels), "page_id", "bad") == [(i, int(i < 60)) for i in range(120)]
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    with duckdb.connect() as con:
        for name in ("pages", "labels"):
            con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
        want = sorted(con.execute(f"select page_id, host, path, rule, verdict from ({queries.URLS_SQL})").fetchall())
    got = rows(queries.op6_url_filter(spark, str(tmp_path)), "page_id", "host", "path", "rule", "verdict")
    assert got == want and {v for _, h, _, _, v in got if h == "bad.net"} == {"block"}


def test_suffixes_of_two_labels(spark):
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.com": ("com", "y.com"), "com": ("com", "com"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: (r.s, r.d) for r in df.select("host", urls.public_suffix(F.col("host")).alias("s"), urls.registered_domain(F.col("host")).alias("d")).collect()}
    assert got == hosts


def test_reputation_is_shrunk(spark):
    rows_ = [("a.x.com", "x.com", "com", 2, 2), ("b.x.com", "x.com", "com", 200, 4), ("c.y.com", "y.com", "com", 0, 0), ("z.org", "z.org", "org", 300, 150)]
    got = {r.host: r for r in urls.host_reputation(spark.createDataFrame(rows_, "host string, domain string, suffix string, n bigint, bad bigint")).collect()}
    assert got["b.x.com"].posterior < got["a.x.com"].posterior < 1.0
    assert got["z.org"].bound > 0.2 and all(r.bound < r.posterior for r in got.values())


def test_decontamination(spark, docs, texts, empty):
    long = next(t for _, t in texts if t and t.count(" ") > 200)
    words = long.split(" ")
    items = [(0, " ".join(words[100:140])), (1, " ".join(words[50:58]) + " nowhere else to be found at all"), (2, None), (3, ""), (4, "x"), (5, " ".join(words[100:140]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    want = set()
    for i, t in texts:
        w = decontaminate.words_of(t or "")
        for k, item in items:
            own = decontaminate.words_of(item or "")
            if own and brute.held(w, own):
                want.add((i, k))
    assert got == want and {k for _, k in got} >= {0, 5}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert decontaminate.contaminated(docs.unionByName(docs), bench).count() == 2 * len(want)


def test_question_and_answer(spark):
    words = [f"w{i}" for i in range(40)]
    other = [f"v{i}" for i in range(40)]
    given = {
        0: words[:26] + other[:4] + words[30:],  # a gap across both, but enough of each
        1: words[:30] + other[:10],  # the question without its answer
        2: other[:30] + words[30:],  # the answer without its question
        3: words[:8] + other[:1] + words[9:12] + other[1:2] + words[13:],
    }
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in given.items()], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(df, bench, least_score=0.3).collect()}
    assert set(got) == {i for i, w in given.items() if brute.held(w, words)} and set(got) >= {3} and not {1, 2} & set(got)
    assert all(min(r.question_overlap, r.answer_overlap) >= 0.65 or r.overlap >= 0.8 for r in got.values())


def test_many_indexes_find_what_one_finds(spark, docs, texts, monkeypatch):
    """Weights don't depend on how items are dealt, nor on how many passes they take."""
    r = random.Random(3)
    long = next(t for _, t in texts if t and t.count(" ") > 200).split(" ")
    items = [(i, " ".join(long[at : at + r.randint(5, 30)])) for i, at in enumerate(r.sample(range(len(long) - 40), 60))] + [(60, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    read = lambda: sorted((x.doc_id, x.item_id, round(x.score, 5), x.overlap) for x in decontaminate.contaminated(docs, bench).collect())
    want = read()
    monkeypatch.setattr(decontaminate, "SHARD", 1000)
    monkeypatch.setattr(decontaminate, "PASS", 3000)
    assert read() == want and len(want) > 60


def test_an_item_without_its_tail_is_found(spark):
    words = [f"w{i}" for i in range(40)]
    df = spark.createDataFrame([(0, "x y z " + " ".join(words[:33]) + " q r"), (1, " ".join(words[:32])), (2, " ".join(words))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {0, 2} and got[0].overlap == 29 / 36 and got[0].answer_overlap < 0.5


def test_a_batch_that_ends_with_a_long_text(spark):
    words = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(0, words), (1, "a " * (decontaminate.PART + 1) + words), (2, words), (3, "b " * (decontaminate.PART + 1))], "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame([(7, words)], "item_id bigint, text string")
    assert {r.doc_id for r in decontaminate.contaminated(df, bench).collect()} == {0, 1, 2}


def test_one_very_long_text(spark):
    words = " ".join(f"w{i}" for i in range(40))
    bench = spark.createDataFrame([(7, words)], "item_id bigint, text string")
    for text, found in (("z " * 200_100, 0), ("z " * 200_100 + words + " z" * 100, 1), (words * 3000, 1)):
        df = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
        assert decontaminate.contaminated(df, bench).count() == found
    index = decontaminate.Index([(7, words)])
    assert index.retrieve([], 0.5) == [] and index.retrieve([index.encode([])], 0.5) == [] and decontaminate.Index([]).retrieve([np.array([-1, -1])], 0.5) == []


def test_block_max_wand_loses_no_item():
    for seed, least in ((4, 0.6), (5, 0.3), (6, 0.9), (7, 0.05)):
        r = random.Random(seed)
        vocabulary = [f"w{i}" for i in range(80)] + [f"rare{i}" for i in range(300)]
        items = [(i, " ".join(r.choices(vocabulary, k=r.randint(3, 30)))) for i in range(90)] + [(90, "w1 w2 w3"), (91, "w1 w2 w3")]
        index = decontaminate.Index(items)
        docs = [r.choices(vocabulary, k=r.randint(0, 300)) for _ in range(12)] + [(t or "").split(" ") for _, t in items[:9]]
        step = max(64, index.longest)
        want = {}
        for d, w in enumerate(docs):
            for at in range(0, max(len(w) - step, 1) if w else 0, step):
                score = [0.0] * len(index.ids)
                for t in set(w[at : at + 2 * step]) & set(index.terms):
                    p = index.terms[t]
                    for i, x in zip(index.item[index.first[p] : index.first[p + 1]].tolist(), index.weight[index.first[p] : index.first[p + 1]].tolist(), strict=True):
                        score[i] += x
                want |= {(d, at, k): s for k, s in enumerate(score) if s >= least}
        got = {(d, at, k): s for d, at, k, s in index.retrieve([index.encode(w) for w in docs], least)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)


def test_archive(spark):
    big = "<p>" + "ä" * 60 + "\r\n\r\nWARC-Type: revisit"
    pages = [(3, "http://a", big), (1, "http://b", big), (2, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "x\r\ny", big + "!")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    kept = warc.write_archive(df)
    records = warc.read_archive(spark, kept)
    assert rows(warc.digest_table(records), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(brute.archive([(p, h) for p, _, h in pages]))
    for r in records.collect():
        if b"WARC-Type: response" in bytes(r.header):
            assert bytes(r.record) == bytes(r.header) + bytes(r.payload) + b"\r\n\r\n"
    assert kept.payloads(spark).count() == 4  # each payload once
    assert warc.digest_table(warc.read_archive(spark, warc.write_archive(df.where("false")))).count() == 0


def test_archive_of_hostile_and_repeated_rows(spark):
    big = "<p>" + "x" * 200
    urls_ = ["http://x/?q=WARC-Type: revisit", "http://x/\r\nWARC-Type: revisit\r\nContent-Length: 0\r\n\r\n", "http://x/\u0085WARC-Type: revisit", "http://x/\u2028WARC-Refers-To: <urn:page:9>", None, ""]
    given = [(i, u, f"{big}{i}") for i, u in enumerate(urls_)] + [(10 + i, u, big + "0") for i, u in enumerate(urls_)]
    given += [(30, "a", big), (30, "a", big), (31, "b", big), (None, "n", big), (None, "n", big), (None, None, None), (40, "c", big * 50 + "\r\n\r\n"), (None, "d", big + "d"), (None, "d", big + "d")]
    df = spark.createDataFrame([(p, u, h, "k", 1, "x", 2) for p, u, h in given], "page_id bigint, url string, html string, digest string, size int, first string, n int").repartition(3)
    kept = warc.write_archive(df)
    records = warc.read_archive(spark, kept)
    order = lambda found: sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[3], r[2]))
    got = order(tuple(r) for r in warc.digest_table(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == order(brute.archive([(p, h) for p, _, h in given]))
    assert kept.payloads(spark).count() == len({h or "" for _, _, h in given})
    for r in records.collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head + b"\r\n\r\n" == bytes(r.header) and rest in (b"\r\n\r\n", bytes(r.payload) + b"\r\n\r\n")


def test_line_dedup(docs, texts, empty):
    found = lines.line_dedup(docs, min_docs=10)
    got = rows(found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.encode("lines.kept", "UTF-8"), 256).alias("s")), "doc_id", "n_lines", "n_dropped", "s")
    assert got == brute.lines(texts)
    assert lines.line_dedup(empty, min_docs=2).count() == 0


def test_first_lines_stay(spark):
    df = spark.createDataFrame([(1, "a\nb"), (0, "A \nc\na"), (2, "a")], "doc_id bigint, text string")
    got = {r.doc_id: r.lines.kept for r in lines.line_dedup(df, min_docs=3, keep_first=True).collect()}
    assert got == {0: "A \nc", 1: "b", 2: ""}


def test_substrings(docs, texts, empty):
    got = rows(substrings.substring_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.substrings(texts)
    assert substrings.substring_dedup(empty).count() == 0


def test_a_hot_anchor_is_dealt_by_windows(spark, docs, texts, monkeypatch):
    """Every bucket heavy: its strings are dealt by longer anchors, down to single windows, and the result is the same."""
    monkeypatch.setattr(substrings, "HEAVY", 0)
    got = rows(substrings.substring_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.substrings(texts)
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh ") for _ in range(90))
    junk = lambda: "".join(r.choice("klmnop ") for _ in range(60))
    given = [(i, f"{junk()}{passage[: 60 + i % 30]}{junk()}{passage}") for i in range(60)] + [(60, passage * 3), (None, passage), (61, junk())]
    df = spark.createDataFrame(given, "doc_id bigint, text string").repartition(5)
    want = sorted(brute.substrings(given), key=lambda x: (x[0] is None, x))
    for bound in (0, 3000, 10**9):
        monkeypatch.setattr(substrings, "HEAVY", bound)
        assert rows(substrings.substring_dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_null_and_repeated_ids_in_substrings(spark):
    a, b = "the quick brown fox jumps over the lazy dog and runs away again ", "another text of quite some length that nobody has written before "
    given = [(None, a), (4, a), (4, "x" + b), (9, b), (None, b), (4, a), (2, "s")]
    df = spark.createDataFrame(given, "doc_id bigint, text string")
    assert rows(substrings.substring_dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.substrings(given), key=lambda r: (r[0] is None, r))


def _runs(texts, length):
    """The runs of windows with one anchor, as {string: six bytes of the anchor's hash}."""
    scan = substrings.Scan(texts, length)
    w, anchor = scan.windows(scan.at)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (w[1:] != w[:-1] + 1))))
    ends = np.append(w[new[1:] - 1], w[-1]) + length
    body = scan.body.tobytes()
    return {body[i:j]: k for i, j, k in zip(w[new].tolist(), ends.tolist(), scan.short(anchor[new]).tolist(), strict=True)}


def _texts_of_one_anchor(n, letters):
    r = random.Random(8)
    least = min((bytes(r.choices(b"klmnopqrst", k=substrings.K)) for _ in range(2000)), key=lambda t: int(substrings.Scan([t * 3], 50).h[0]))
    pool = [bytes(r.choices(letters, k=26)) for _ in range(8)]

    def side():
        own = bytearray(r.choice(pool))
        own[r.randrange(26)] = r.choice(letters)
        return bytes(own)

    return [side() + least + side() for _ in range(n)]


def test_windows_meet_by_longer_anchors(monkeypatch):
    """However few bytes a transform takes, equal windows of different strings come in one part and class."""
    strings = _runs([*_texts_of_one_anchor(150, b"ab"), b"xy" * 60, b"x" * 51], 50)
    texts, keys = list(strings), np.array(list(strings.values()))
    want = {}
    for i, t in enumerate(texts):
        for o in range(len(t) - 49):
            want.setdefault(t[o : o + 50], set()).add((i, o))
    want = {w: x for w, x in want.items() if len({i for i, _ in x}) > 1}
    assert len(want) > 100
    for bound in (0, 200, 3000, 10**7):
        monkeypatch.setattr(substrings, "TRANSFORM", bound)
        got = {}
        for part, (string, offset, cls) in enumerate(substrings._classed(texts, keys, 50, 27)):
            for i, o, c in zip(string.tolist(), offset.tolist(), cls.tolist(), strict=True):
                got.setdefault((part, c), set()).add((i, o))
        found = {}
        for places in got.values():
            (window,) = {texts[i][o : o + 50] for i, o in places}
            assert window not in found or len({i for i, _ in places}) == 1
            found[window] = max(found.get(window, set()), places, key=len)
        assert all(found[w] == x for w, x in want.items())


def test_pieces_of_strings():
    """Pieces of all lengths of anchors hold each window once, and equal windows have equal keys."""
    texts = list(_runs([*_texts_of_one_anchor(30, b"ab"), b"some other words that are long enough to have a few windows of their own"], 50))
    for block in (27, 14, 7, 4, 2, 1):
        keys, n = {}, 0
        for s, a, size, key in zip(*(x.tolist() for x in substrings._pieces(texts, 50, block)), strict=True):
            for o in range(a, a + size - 49):
                n += 1
                keys.setdefault(texts[s][o : o + 50], set()).add(key)
        assert n == sum(len(t) - 49 for t in texts) and all(len(k) == 1 for k in keys.values())


def test_classes_of_windows():
    r = random.Random(3)
    for length in (4, 50):
        base = [bytes(r.choice(b"ab\x00c") for _ in range(150)) for _ in range(3)]
        strings = list({b"".join(r.choice(base)[r.randint(0, 20) : r.randint(60, 150)] for _ in range(2)) for _ in range(8)})
        string, offset, cls = substrings.classes(strings, length)
        found = {}
        for s, o, c in zip(string.tolist(), offset.tolist(), cls.tolist(), strict=True):
            found.setdefault(c, set()).add(strings[s][o : o + length])
        assert all(len(v) == 1 for v in found.values())
        assert len(found) == len({s[i : i + length] for s in strings for i in range(len(s) - length + 1)})


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)], "u bigint, v bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_batches_are_handled_in_parts(monkeypatch):
    import pyarrow as pa

    from quillon.llm import common

    rows_ = [{"id": i, "text": "x" * i} for i in range(50)] + [None]
    batch = pa.record_batch([pa.array(rows_)], names=["row"])
    for size, many in ((200, True), (10**9, False)):
        monkeypatch.setattr(common, "SLICE", size)
        parts = list(common.sliced(batch))
        assert [r for p in parts for r in p.column(0).to_pylist()] == rows_ and (len(parts) > 1) == many
        assert [t for p in parts for t in p.column(0).field(1).to_pylist()][:50] == [r["text"] for r in rows_[:50]]
    assert [p.num_rows for p in common.sliced(batch.slice(0, 0))] == [0]


def test_long_urls(spark):
    """Letters of one and of two UTF-16 units in turn, before, within and without ://."""
    mixed = "é😀" * 500_000
    hosts = [(1, mixed + "://H.org/a?b", "h.org", "/a"), (2, mixed, "", ""), (3, f"x://{mixed}/p#q", mixed, "/p"), (4, f"x://h/{mixed}?z", "h", f"/{mixed}"), (5, "a://B?c/d", "b", ""), (6, "a://b#/c", "b", "")]
    hosts += [(7, None, "", ""), (8, "://", "", ""), (9, "a://b\n.c/d\ne?f", "b\n.c", "/d\ne"), (10, "a://b://c/d", "b:", "//c/d")]
    df = spark.createDataFrame([x[:2] for x in hosts], "page_id bigint, url string")
    host, path = urls.host_and_path(F.col("url"))
    assert sorted(tuple(r) for r in df.select("page_id", host, path).collect()) == [(i, h, p) for i, _, h, p in hosts]
    outcomes = spark.createDataFrame([(1, 1), (5, 0)], "page_id bigint, bad int")
    assert urls.url_filter(df, outcomes).count() == len(hosts)


def test_labels_without_documents(spark, data, caplog):
    """Labels of documents that aren't there don't push out those that are; a missing class is told."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    own = quality.train(docs, labels, sample=60)
    more = spark.range(10**9, 10**9 + 20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    with_more = quality.train(docs, labels.unionByName(more), sample=60)
    assert np.array_equal(own.emission, with_more.emission) and own.emission.any()
    assert quality.train(docs, more) is quality.PLAIN and "both classes" in caplog.text
