"""Small fixtures against brute force: nulls, empties, repeated rows, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from treelens.llm.jaccard import near_dedup_stage, near_documents
from treelens.llm.html import BlockRules, extract, main_text
from treelens.llm.language import NetShape, fit, predict
from treelens.llm.licenses import license_scan
from treelens.llm.lines import line_dedup, line_dedup_stage
from treelens.llm.mixing import MixRules, fit_mix, mixing, mixing_stage, rates
from treelens.llm.packing import TOKENIZER, curve_key, pack
from treelens.llm.quality import quality, quality_stage
from treelens.llm.vectors import VectorRules, near_vectors
from treelens.llm.warc import WarcRules, members_of, read_archives, write_archives

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, row_key string, body string"


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgé"), rng.integers(2, 7))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    base = [sentence(rng, 60) for _ in range(6)]
    edited = base[0].split()
    edited[5] = "changed"
    shared = "\n".join(sentence(rng, 12) for _ in range(8))
    return [
        *base,
        base[1],
        base[1].upper(),
        " ".join(edited),
        "Licensed under CC BY-NC 4.0. " + base[2] + " All rights, reserved! general PUBLIC license cc by",
        base[3] + "\n" + shared + "\n" + base[4],
        sentence(rng, 20) + "\n" + shared,
        None,
        "",
        "   \n \n",
        "two words",
        "Two  words",
        "one",
        "!!! ### 123",
        "| a | b | c |\n" * 30,
        "word " * 80,
        "ab <|endoftext|> İß  x y é 'll don't 12345",
        sentence(rng, 9000),
    ]


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(i, t, None, "s", None, 7, "k", "b") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, texts[0], None, None, None, 7, "k", "b")], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect() if r[key] is not None}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_license_scan(documents, empty, texts):
    found = by_id(license_scan(documents))
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        at = [(k, name) for p, name in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
        row = found[i]
        assert (row.n_words, row.n_base) == (len(words), len(at))
        assert row.first_word == (min(at)[0] if at else None)
        assert row.last_word == (max(at)[0] if at else None)
        assert row.base_labels == ",".join(sorted({name for _, name in at}))
        assert set(row.base_labels.split(",")) <= set(row.labels.split(",")) and 0 <= row.score <= 1
    assert "cc-by-nc" in found[9].labels
    assert license_scan(documents).count() == documents.count()
    assert license_scan(empty).count() == 0


def test_license_spans_survive_small_edits(spark):
    text = "x y Permission is hereby granted free of any charge to any person obtaining a copy of this software and associated files to deal in the software without restriction z"
    row = license_scan(spark.createDataFrame([(1, text), (2, "permission is a word")], "doc_id long, text string"))
    assert {r.doc_id: r.labels for r in row.collect()} == {1: "mit", 2: ""}


def test_line_dedup(documents, empty, texts):
    found = by_id(line_dedup(documents))
    # The passages of documents 3 and 4 go, the lines that document 11 repeats stay.
    assert found[10].text == "\n".join(texts[10].split("\n")[1:-1]) and found[10].n_removed == 2
    assert len(found[11].text) < len(texts[11]) and found[11].n_removed >= 1
    for i in (1, 2, 5, 22):
        assert found[i].text == texts[i]
    assert found[12].text is None and found[13].text == ""
    assert found[6].text == ""  # a passage-long line that an earlier document has
    assert line_dedup(documents).count() == documents.count()
    stage = line_dedup_stage(documents)
    assert stage.columns == documents.columns
    assert 6 not in by_id(stage) and 12 in by_id(stage)
    assert line_dedup(empty).count() == 0


def test_line_dedup_takes_whole_passages(spark):
    rng = np.random.default_rng(41)
    passages = [[sentence(rng, 55 // n + 1) for _ in range(n)] for n in (2, 3, 4, 5, 6)]
    rows, expected = [], {}
    for k, passage in enumerate(passages):
        for copy in range(3):
            before, after = sentence(rng, 10), sentence(rng, 10)
            i = 10 * copy + k
            rows.append((i, "\n".join([before, *passage, after])))
            expected[i] = rows[-1][1] if copy == 0 else before + "\n" + after
    # An exact copy of several lines goes whole; a run of 40 words stays.
    short = [sentence(rng, 20), sentence(rng, 20)]
    rows += [(100, rows[0][1]), (101, "\n".join(["x", *short])), (102, "\n".join(["y", *short]))]
    expected |= {100: "", 101: rows[-2][1], 102: rows[-1][1]}
    # Of lines that repeat themselves the first passage stays whole; blank lines do not matter.
    again = sentence(rng, 30)
    rows += [(103, "\n".join([again] * 5)), (104, passages[0][0] + "\n\n" + passages[0][1] + "\nend")]
    expected |= {103: "\n".join([again] * 2), 104: "end"}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {i: r.text for i, r in by_id(line_dedup(df)).items()} == expected
    assert 100 not in by_id(line_dedup_stage(df))


def jaccard_components(texts):
    sets = []
    for text in texts:
        words = words_of((text or "").translate(LOWER))
        grams = {tuple(words[k : k + 4]) for k in range(len(words) - 3)}
        sets.append(grams if len(words) >= 4 else {tuple(words)} if words else set())
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return sets, label


def test_jaccard_join(documents, empty, texts):
    found = by_id(near_documents(documents))
    sets, label = jaccard_components(texts)
    for i in range(len(texts)):
        assert (found[i].n_shingles, found[i].component_id) == (len(sets[i]), label[i])
    stage = near_dedup_stage(documents)
    assert stage.columns == documents.columns
    assert set(by_id(stage)) == {i for i in range(len(texts)) if label[i] == i}
    assert near_documents(empty).count() == 0


def test_jaccard_chains_of_near_copies(spark):
    rng = np.random.default_rng(5)
    words, rows = sentence(rng, 200).split(), []
    for _ in range(40):
        words[rng.integers(0, 200)] = "w%d" % rng.integers(1 << 30)
        rows.append(" ".join(words))
    rows += [" ".join(rng.permutation(words)) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    found = by_id(near_documents(df))
    _, label = jaccard_components(rows)
    assert [found[i].component_id for i in range(len(rows))] == label


def test_language(spark, documents, empty):
    rng = np.random.default_rng(9)
    kinds = {"aa": "abcde", "bb": "uvwxy", "cc": "éèàçö"}
    rows = []
    for i in range(240):
        lang = list(kinds)[i % 3]
        text = " ".join("".join(rng.choice(list(kinds[lang] + "mn"), 5)) for _ in range(60))
        rows.append((i, text, lang if i % 7 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = fit(df.where("doc_id < 120"), NetShape(steps=150))
    seen = predict(df.where("doc_id >= 120"), net, ["doc_id"]).collect()
    assert np.mean([r.lang_pred == list(kinds)[r.doc_id % 3] for r in seen]) > 0.95
    other = by_id(predict(documents, net, ["doc_id"]))
    assert [other[i].lang_pred for i in (12, 13, 14, 18)] == ["und"] * 4
    assert all(0 <= r.score <= 1 for r in other.values())
    assert predict(empty, net, ["doc_id"]).count() == 0
    nothing = fit(empty.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in predict(documents, nothing, ["doc_id"]).collect()} == {"und"}


def test_mixing(spark, documents, empty):
    rng = np.random.default_rng(13)
    rows = []
    for i in range(400):
        marks = {0: "vile", 1: "fine", 2: "flat"}[i % 3]
        rows.append((i, sentence(rng, 30) + " " + marks))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = {0: "toxic", 1: "good", 2: "plain"}
    labels = spark.createDataFrame([(i, names[i % 3]) for i in range(300)] + [(None, "good"), (1, None)], "doc_id long, domain string")
    rules = MixRules(targets={"good": 1.0, "plain": 0.5, "toxic": 0.05})
    fitted, table = fit_mix(df, labels, rules)
    got = table.toPandas()
    p = np.array(got.p.tolist())
    total = (got.n_tokens.to_numpy() * rates(p, fitted.steps)) @ p
    assert np.allclose(total, fitted.wanted, rtol=0.05)
    assert np.all(np.abs(fitted.reached - fitted.wanted) <= 0.01 * fitted.wanted)
    by = mixing(df, labels, rules).toPandas()
    assert by[by.doc_id % 3 == 0].rate.max() < 0.5 < by[by.doc_id % 3 == 1].rate.min()
    clashing = df.withColumn("p", df.doc_id).withColumn("treelens_draw", df.doc_id).withColumn("draw", df.doc_id)
    stage = mixing_stage(clashing, labels)
    assert stage.columns == clashing.columns
    kept = Counter(r.doc_id % 3 for r in stage.collect() if r.treelens_draw == r.draw == r.doc_id)
    whole = Counter(r.doc_id % 3 for r in df.select("doc_id").collect())
    assert kept[0] <= 0.2 * whole[0] and kept[1] >= 0.9 * whole[1] and 0.3 * whole[2] <= kept[2] <= 0.7 * whole[2]
    assert mixing(documents, labels.limit(0)).count() == documents.count()
    assert mixing(empty, labels).count() == 0


def test_mixing_stage_meets_targets(spark):
    rng = np.random.default_rng(43)
    names = {0: "toxic", 1: "good", 2: "plain"}
    marks = {0: "vile", 1: "fine", 2: "flat"}
    rows = [(i, sentence(rng, 20) + " " + marks[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame([(i, names[i % 3]) for i in range(600)], "doc_id long, domain string")
    clean = known.where("domain <> 'toxic'")
    for labels in (known, clean):
        rules = MixRules()
        source = df if labels is known else df.where("doc_id % 3 > 0")
        fitted, table = fit_mix(source, labels, rules)
        weight = {r.doc_id: r.n_tokens * np.array(r.p) for r in table.collect()}
        total = sum(weight[r.doc_id] for r in mixing_stage(source, labels, rules).collect())
        supply = sum(weight.values())
        wanted = np.array([rules.targets[d] for d in fitted.model.domains]) * supply
        assert np.all(np.abs(total - wanted) <= 0.05 * supply)


def test_packing(documents, empty, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    rows = pack(documents).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].sequence_length and at & (at - 1) == 0 and at <= 4096
    assert pack(empty).count() == 0


def test_curve_visits_neighbours():
    points = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    walk = points[np.argsort(curve_key(points, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_warc_round_trip(spark):
    big, small = "é<p>" * 3000, "x" * 10
    rows = [(0, None), (1, ""), (2, small), (3, small), (4, big), (5, big), (6, "y" * 999), (7, "y" * 999), (8, "z\r\n" * 700), (9, big)]
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nX: 1", h, 1) for i, h in rows], "page_id long, url string, html string, row long")
    rules = WarcRules(segment=1500, archive=4000)
    found = by_id(read_archives(write_archives(pages.repartition(3), rules)), "page_id")
    for i, html in rows:
        raw = (html or "").encode()
        r = found[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest()) and r.error is None
        revisit = html == big and i != 9
        assert (r.record_type, r.refers_to) == (("revisit", 9) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == raw
    assert read_archives(write_archives(pages.limit(0))).count() == 0


@pytest.mark.parametrize("listed", [500_000, 0])
def test_warc_references_name_records(spark, listed):
    big, tied = "é<p>" * 3000, "tie" * 900
    rows = [(1, big), (2, big), (None, big), (5, tied), (5, tied), (4, tied), (None, "n" * 2000), (None, "n" * 2000), (8, "s"), (8, "s")]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'http://a' AS url")
    stored = write_archives(pages.repartition(3), WarcRules(segment=700, listed=listed))
    heads = [fields for r in stored.collect() for fields, _ in members_of(bytes(r.content))]
    ids = [h[b"warc-record-id"] for h in heads]
    assert len(ids) == len(set(ids)) and sum(h[b"warc-type"] == b"warcinfo" for h in heads) == stored.count()
    responses = {h[b"warc-record-id"] for h in heads if h[b"warc-type"] == b"response"}
    told = [h[b"warc-refers-to"] for h in heads if b"warc-refers-to" in h]
    assert len(told) == 2 and set(told) <= responses
    found = Counter((r.page_id, r.record_type, r.refers_to) for r in read_archives(stored).collect())
    assert found == Counter({
        (1, "revisit", 2): 1, (None, "revisit", 2): 1, (2, "response", None): 1, (5, "response", None): 2,
        (4, "revisit", 5): 1, (None, "response", None): 2, (8, "response", None): 2,
    })


def test_warc_missing_segment_is_told(spark):
    from treelens.llm.warc import assembled, records, write_archives as write

    pages = spark.createDataFrame([(1, "u", "a" * 9000)], "page_id long, url string, html string")
    found = records(write(pages, WarcRules(segment=2000)))
    assert assembled(found.where("coalesce(number, 0) <> 2")).first().error == "segments missing or doubled"
    assert assembled(found.where("total IS NULL")).first().error is not None


def test_near_vectors(spark):
    rng = np.random.default_rng(21)
    base = rng.normal(size=(30, 24))
    rows = [*base, *(base[:10] + rng.normal(0, 0.12, (10, 24))), *base[:5], *(base[3] + rng.normal(0, 0.25, (40, 24)))]
    vectors = [list(map(float, v)) for v in rows] + [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None], [1.0, 0.0], [0.9, 0.1]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    found = by_id(near_vectors(df, VectorRules(block=8, part=8)), "vec_id")
    unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(rows))
    for _ in rows:
        label = np.array([min(label[i], label[link[i]].min(initial=len(rows))) for i in range(len(rows))])
    for i in range(len(rows)):
        r = found[i]
        assert (r.n_links, r.component_id, r.kept) == (link[i].sum(), label[i], label[i] == i)
    n = len(rows)
    assert [found[n + k].n_links for k in range(7)] == [0, 0, 0, 0, 0, 1, 1] and found[n + 6].component_id == n + 5
    assert near_vectors(df.limit(0)).count() == 0


PROSE = "This is the story of the people who were there and of what they had to say about it. " * 4
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/a">Home</a></ul></nav><div class="cookie-notice">{PROSE}</div>
<article><h1>Title &amp; more</h1><p>Short.</p><p>{PROSE}<br>x &lt; y<!-- c --></p><form>Mail<input></form>
<section id="comments"><p>{PROSE}</p></section></article><aside><p>{PROSE}</p></aside><footer>(c)</footer>"""


def test_html(spark):
    text = " ".join(PROSE.split())
    assert main_text(PAGE, BlockRules()) == f"Title & more Short. {text} x < y"
    plain = PAGE.replace("article>", "div>")
    assert main_text(plain, BlockRules()) == f"Title & more Short. {text} x < y"
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (3, "v", "", 5), (4, "w", "a < b <p", 5), (1, "u", PAGE, 5)]
    df = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long"))
    got = df.collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[2] == "" and df.limit(0).count() == 0


def test_quality(documents, empty, texts):
    found = by_id(quality(documents))
    for i, text in enumerate(texts):
        words, r = words_of(text), found[i]
        runs = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) for j in range(3) if runs[tuple(words[k : k + 3])] > 1}
        lines = [x for x in (text or "").split("\n") if words_of(x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    assert found[0].kept and found[22].kept and not found[19].kept
    stage = quality_stage(documents)
    assert stage.columns == documents.columns and by_id(stage)[0].text == texts[0]
    assert quality(empty).count() == 0 and quality_stage(empty).count() == 0


def test_pipeline_near_copies(spark):
    import corpus_pipeline

    # Of 96 runs of five words, 86 of 106 are common with 10 words replaced, 85 of 107 with 11.
    def text(k, replaced):
        return " ".join([f"w{k}x{i}" for i in range(100 - replaced)] + [f"new{k}x{i}" for i in range(replaced)])

    rows = [(1, text(1, 0)), (2, text(1, 10)), (3, text(2, 0)), (4, text(2, 11))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert set(by_id(corpus_pipeline.near_dedup(spark, df, ""))) == {1, 3, 4}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(33)
    rows = [(i, sentence(rng, 80), "en", "s", 0) for i in range(30)]
    rows += [(30 + i, rows[i][1], "en", "s", 0) for i in range(5)] + [(40, "short", "en", "s", 0), (41, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(range(30))
