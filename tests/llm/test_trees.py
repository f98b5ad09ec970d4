"""Trie, byte-level BPE and Merkle manifest against brute force on small fixtures."""

import base64
import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from treelens.llm import bpe, merkle, trie
from treelens.llm.bpe import bpe_decode, bpe_encode, encode_text
from treelens.llm.merkle import MerkleRules, merkle_manifest
from treelens.llm.trie import TrieRules, branched, paths_of, prefix_trie


def hexed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


# ---- trie ----


def rebuilt_by_hand(rows, every=5, spans=9):
    turns = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            tie = hexed(f"{len(role.encode())}:", role, text)[:32]
            turns[conv_id].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [value for _, value in sorted(found)] for c, found in turns.items()}
    result = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % spans
        result[c] = own.get(c - c % every, [])[:h] + mine[h:]
    return result


def trie_by_hand(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, rows = defaultdict(list), []
    for node in members:
        if node:
            children[node[:-1]].append(node)
    total = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        leaves = 0 if children[node] else 1
        for child in children[node]:
            leaves, saved = leaves + total[child][0], saved + total[child][1]
        total[node] = leaves, saved
    for node, own in members.items():
        parent = min(members[node[:-1]]) if node else None
        joined = ",".join(map(str, sorted(ends[node])))
        rows.append((min(own), len(node), parent, len(own), len(children[node]), *total[node], hexed(joined)))
    return sorted(rows, key=lambda r: (r[1], r[0]))


CONVERSATIONS = "conv_id long, turn long, role string, text string, shard string, path string, base long"


def conversation_rows(seed, ids, copies):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "lost", "s", "p", 1), (7_000, None, "user", "late", "s", "p", 1), (7_000, None, None, None, "s", "p", 1)]
    for c in range(ids):
        for turn in range(rng.randrange(1, 7)):
            text = rng.choice([None, "", "hé", "ça va", "same", f"own {c}"])
            rows.append((c, turn, rng.choice(["user", "assistant", None]), text, "s", "p", 1))
    # A third of all conversations are copies of one, and one is long.
    for c in range(copies):
        rows += [(1_000 + 5 * c, turn, "user", f"hot {turn}", "s", "p", 1) for turn in range(3)]
    rows += [(5_000, turn, "user", f"turn {turn % 7}", "s", "p", 1) for turn in range(600)]
    return rows + rows[3:6] + [(5_001, 0, "user", "turn 0", "s", "p", 1)]


@pytest.mark.parametrize("rules", [TrieRules(), TrieRules(ids_per_row=3, sampled=2), TrieRules(skeleton_nodes=4), TrieRules(shard_bytes=500)])
def test_trie_has_the_nodes_of_brute_force(spark, rules):
    rows = conversation_rows(1, 120, 80)
    expected = trie_by_hand(rebuilt_by_hand(rows))
    data = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    found = prefix_trie(paths_of(branched(data)), rules).collect()
    assert sorted(map(tuple, found), key=lambda r: (r[1], r[0])) == expected


def test_no_conversation_has_no_node_and_one_without_turns_is_in_the_root(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie(paths_of(branched(empty))).collect() == []
    alone = next(c for c in range(1, 50, 5) if zlib.crc32(str(c).encode()) % 9 > 0)
    data = spark.createDataFrame([(alone, 0, "user", "gone", "s", "p", 1)], CONVERSATIONS)
    [row] = prefix_trie(paths_of(branched(data))).collect()
    assert tuple(row) == (alone, 0, None, 1, 0, 1, 0, hexed(str(alone)))


def test_splitters_lie_between_paths():
    turn = [bytes([k]) * 16 for k in range(5)]
    sample = sorted([(turn[1] * n + turn[k], 10 * n + k) for n in range(4) for k in range(5)] + [(turn[2], 3), (turn[2], 4)])
    for shards in (1, 2, 7, 100):
        chosen = trie.choose_splitters(sample, shards)
        assert chosen == sorted(set(chosen)) and len(chosen) < max(shards, 1)
        assert all(any(row < cut for row in sample) and any(row >= cut for row in sample) for cut in chosen)


# ---- byte-level BPE ----


def library(name):
    ranks = open(public_tokenizers.path(name), "rb").read().split()
    ranks = {base64.b64decode(token): int(rank) for token, rank in zip(ranks[::2], ranks[1::2])}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", [bpe.RANKS, "byte_bpe_50k.tiktoken"])
def test_ids_are_those_of_the_library(name):
    rng = random.Random(4)
    ranges = [(32, 127), (32, 0x600), (0x4E00, 0x9FFF), (0xE000, 0x110000), (9, 14), (0x2000, 0x2030), (0x558, 0x58D), (0xA7C0, 0xA7F5)]
    texts = ["", " ", "a" * 3000, "ab" * 999 + "\n" * 700 + "é" * 500, "we'll  'LL <|endoftext|>\r\n\r\n x ", "՘꟎\U0001df00 1\U0001246f"]
    for _ in range(1500):
        texts.append("".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(60))))
        texts.append("".join(rng.choice(["ing", "the", "e", "en", "qu", " ", "  ", "é", "ü", "\n", "12"]) for _ in range(rng.randrange(90))))
    path, encoding = public_tokenizers.path(name), library(name)
    for text in texts:
        ids = np.frombuffer(encode_text(text, path, public_tokenizers.PATTERN), "<u4").tolist()
        assert ids == encoding.encode_ordinary(text), text


def test_long_texts_are_cut_into_blocks_of_pieces_only(monkeypatch):
    path, text = public_tokenizers.path(bpe.RANKS), "  word'll 123\n\n\n é" * 4000
    whole = encode_text(text, path, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 3)
    bpe.remembered.cache_clear()
    assert encode_text(text, path, public_tokenizers.PATTERN) == whole
    bpe.remembered.cache_clear()


def test_a_vocabulary_that_merges_did_not_make_is_refused(tmp_path):
    ranks = [bytes([k]) for k in range(256)] + [b"abc"]
    file = tmp_path / "ranks"
    file.write_bytes(b"".join(base64.b64encode(token) + b" %d\n" % k for k, token in enumerate(ranks)))
    with pytest.raises(ValueError, match="256"):
        bpe.Vocabulary(str(file))


def test_encoding_and_decoding_go_round(spark):
    rows = [(1, "Hello wörld", 5, "x"), (2, None, 5, "x"), (3, "", 5, "x"), (1, "Hello wörld", 5, "x"), (None, "a b", 5, "x"), (4, "z" * 300_000 + " end", 5, "x")]
    data = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids string")
    encoded = bpe_encode(data).withColumn("bytes", bpe_decode(F.col("ids")))
    found = [(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.bytes)) for r in encoded.collect()]
    encoding = library(bpe.RANKS)
    ids = [encoding.encode_ordinary(text or "") for _, text, *_ in rows]
    expected = [(row[0], len(own), np.array(own, "<u4").tobytes(), (row[1] or "").encode()) for row, own in zip(rows, ids)]
    key = lambda row: (row[0] or 0, row[3])
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert bpe_encode(data.limit(0)).count() == 0
    assert spark.range(1).select(bpe_decode(F.lit(None).cast("binary"))).first()[0] is None


# ---- Merkle manifest ----


def manifest_by_hand(rows, arity=3):
    def size(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def climb(level, paths):
        at = list(range(len(level)))
        while len(level) > 1:
            for leaf, place in enumerate(at):
                first = place - place % arity
                paths[leaf] += ["".join(level[first:place]), "".join(level[place + 1 : first + arity])]
                at[leaf] = place // arity
            level = [hexed(*level[k : k + arity]) for k in range(0, len(level), arity)]
        return level[0]

    sources = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        leaf = hexed(*map(size, (doc_id, source, lang, n_chars, text)))
        cut = None if text is None else text.replace("\n", "")
        odd = doc_id is None or zlib.crc32(str(doc_id).encode()) % 2
        changed = None if odd else hexed(*map(size, (doc_id, source, lang, n_chars, cut)))
        sources[source].append((doc_id is not None, doc_id or 0, leaf, changed, doc_id))
    names = sorted(sources, key=lambda name: (name is not None, (name or "").encode()))
    paths, subroots = {}, []
    for name in names:
        sources[name].sort(key=lambda row: row[:3])
        paths[name] = [[] for _ in sources[name]]
        subroots.append(climb([row[2] for row in sources[name]], paths[name]))
    above = [[] for _ in names]
    root = climb(subroots, above)
    result = []
    for name, outer, subroot in zip(names, above, subroots):
        for (_, _, leaf, changed, doc_id), inner in zip(sources[name], paths[name]):
            path, node = inner + outer, changed or leaf
            for left, right in zip(path[::2], path[1::2]):
                node = hexed(left, node, right)
            result.append((doc_id, leaf, subroot, root, hexed(*path), node))
    return sorted(result, key=str)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, pos long, node string"


def document_rows(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for name, n in sizes.items():
        for doc_id in rng.sample(range(10_000), n):
            text = rng.choice([None, "", "a\nb\n", "héllo\n", f"text {doc_id}", "\n" * 50 + "x" * 1000])
            rows.append((doc_id, text, rng.choice(["en", None]), name, rng.choice([None, 5]), "k", 1, "n"))
    return rows + rows[:3] + [(None, "no id\n", "en", "b", 1, "k", 1, "n"), (None, "none", None, "b", 1, "k", 1, "n")]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"hot": 250, "b": 1, None: 9, "": 10, "é": 27, "z": 28, "y": 82}, {f"s{k}": 1 + k % 3 for k in range(40)}])
@pytest.mark.parametrize("rules", [MerkleRules(), MerkleRules(levels=2, rows_per_range=20), MerkleRules(levels=1)])
def test_manifest_is_that_of_brute_force(spark, sizes, rules):
    rows = document_rows(2, sizes)
    data = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    found = merkle_manifest(data, rules).select(*names).collect()
    assert sorted(map(tuple, found), key=str) == manifest_by_hand(rows)


def test_a_proof_folds_to_the_root_and_a_tampered_one_does_not(spark):
    rows = document_rows(5, {"hot": 120, "b": 4})
    found = merkle_manifest(spark.createDataFrame(rows, DOCUMENTS), MerkleRules(levels=2)).collect()
    for row in found:
        node = row.leaf
        for left, right in zip(row.proof[::2], row.proof[1::2], strict=True):
            node = hexed(left, node, right)
        assert node == row.root
        assert (row.folded_root == row.root) == (row.changed is None or row.changed == row.leaf)


def test_an_empty_manifest_is_empty(spark):
    assert merkle_manifest(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_a_block_alone_stops_at_one_node():
    rules = MerkleRules(levels=2)
    assert [len(level) for level in merkle.block_levels(["a"], 0, rules)] == [1]
    assert [len(level) for level in merkle.block_levels(["a"], 3, rules)] == [1, 1, 1]
    assert [len(level) for level in merkle.block_levels(["a"] * 9, 0, rules)] == [9, 3, 1]
    assert [len(level) for level in merkle.block_levels(["a"] * 4, 0, rules)] == [4, 2, 1]
