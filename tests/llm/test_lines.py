"""Repeated passages and line rules on documents that earlier rules treated wrongly."""

import random
import textwrap
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa

from treelens.llm.arrays import texts_in
from treelens.llm.lines import ChunkRules, line_dedup, line_dedup_stage
from treelens.llm.quality import QualityRules, judge_slice


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n))


def dedup_by_hand(rows, least):
    """Every shortest run of lines from and up to each line, the first in order of place stays."""
    runs = defaultdict(list)
    for doc_id, text in rows:
        filled = [(at, line) for at, line in enumerate((text or "").split("\n")) if line.split()]
        spans = set()
        for i in range(len(filled)):
            for step in (1, -1):
                total, k = 0, i
                while 0 <= k < len(filled) and total < least:
                    total += len(filled[k][1].split())
                    k += step
                if total >= least:
                    spans.add((i, k - 1) if step == 1 else (k + 1, i))
        for i, k in spans:
            body = "\n".join(line for _, line in filled[i : k + 1])
            runs[body].append((doc_id, filled[i][0], filled[k][0]))
    gone = defaultdict(set)
    for places in runs.values():
        stays = min(places)
        for place in places:
            first, last = place[1:]
            if place != stays:
                if place[0] == stays[0]:
                    first = max(first, stays[2] + 1)
                gone[place[0]] |= set(range(first, last + 1))
    return {d: "\n".join(x for at, x in enumerate((t or "").split("\n")) if at not in gone[d]) if gone[d] else t for d, t in rows}


def test_repeated_passages_are_those_of_brute_force(spark):
    rng = random.Random(8)
    passages = ["\n".join(words(rng, 60 // n) for _ in range(n)) for n in (2, 3, 4, 5, 6)]
    rows = []
    for d in range(60):
        parts = [words(rng, rng.randint(1, 25)) for _ in range(rng.randint(0, 6))]
        for passage in rng.sample(passages, rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), passage + rng.choice(["", "\n", "\n  \n"]))
        rows.append((d, "\n".join(parts)))
    rows += [(60, None), (61, ""), (62, rows[0][1]), (63, "\n".join([passages[0]] * 3))]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.text for r in line_dedup(data, ChunkRules(min_words=50)).collect()}
    assert found == dedup_by_hand(rows, 50)


def test_the_stage_keeps_columns_of_any_name(spark):
    rng = random.Random(9)
    passage = "\n".join(words(rng, 20) for _ in range(4))
    rows = [(1, passage + "\nown line", 77, 78, 79), (2, "first line here\n" + passage, 77, 78, 79)]
    data = spark.createDataFrame(rows, "doc_id long, text string, n_removed long, n_chunks long, left long")
    found = {r.doc_id: tuple(r) for r in line_dedup_stage(data).collect()}
    assert found == {1: rows[0], 2: (2, "first line here", 77, 78, 79)}


def test_a_document_of_many_lines_takes_time_that_grows_with_it(spark):
    rng = random.Random(10)

    def seconds(n):
        text = "\n".join(words(rng, 6) for _ in range(n))
        data = spark.createDataFrame([(1, text), (2, "a b c")], "doc_id long, text string")
        start = time.perf_counter()
        assert {r.n_removed for r in line_dedup(data).collect()} == {0}
        return time.perf_counter() - start

    seconds(100)
    assert seconds(20_000) < 15


def test_wrapped_prose_is_no_debris():
    rng = random.Random(11)
    prose = " ".join(words(rng, rng.randint(8, 16)).capitalize() + "." for _ in range(20))
    menu = "\n".join(words(rng, 2).capitalize() for _ in range(60))
    texts = [textwrap.fill(prose, 72), prose, menu, textwrap.fill(prose, 40)]
    for _, _, part in texts_in(pa.array(texts)):
        found = judge_slice(part, QualityRules(), True)
    assert np.array_equal(found["kept"], [True, True, False, True])
    assert found["lost_words"][1] == 0 and found["lost_words"][0] <= 0.2 * found["n_words"][0]
