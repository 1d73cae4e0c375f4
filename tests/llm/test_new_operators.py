"""Lexical search, filter audit and token files against brute-force versions and round trips."""

from __future__ import annotations

import itertools
import math
import random
import re
import time
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sugarline.llm import bpe_ids, filter_audit, lexical_search, rans, secrets, token_files
from tests.llm.texts import empty_table, odd_rows, odd_table, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- lexical search ------------------------------------------------------------------------------


def search_by_brute_force(docs, items, k):
    words = [TERM.findall((t or "").translate(UPPER)) for _, t in docs]
    size = [len(w) for w in words]
    n, length = sum(s > 0 for s in size), sum(size)
    df = Counter(t for w in words for t in set(w))
    queries = defaultdict(set)
    for item, text in items:
        queries[item] |= set(TERM.findall((text or "").translate(UPPER)))
    out = []
    for item, own in queries.items():
        scored = []
        for (doc_id, _), w in zip(docs, words, strict=True):
            tf, score = Counter(w), 0
            for t in own & set(tf):
                m = 100 - 50 + (50 * len(w) * n) // length
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, i + 1, None if no else d, -s) for i, (s, no, d) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def search_rows():
    rng = random.Random(8)
    docs = [(r[0], r[1]) for r in odd_rows()]
    docs += [(100 + i, prose(rng, rng.randint(1, 80), rng.choice(["en", "fr"]))) for i in range(120)]
    copy = prose(rng, 30)
    docs += [(300 - i, copy) for i in range(40)]
    shared = prose(rng, 8)
    items = [(i, f"{shared} {prose(rng, rng.randint(1, 12))}") for i in range(12)]
    items += [(20, None), (21, ""), (22, "!?"), (23, "nowhere at-all"), (24, copy.upper()), (24, "Été rivière"), (None, "The stones")]
    return docs, items


@pytest.mark.parametrize("k,terms", [(50, lexical_search.TERMS_A_PASS), (3, 40)])
def test_search_equals_brute_force(spark, k, terms):
    docs, items = search_rows()
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1)).repartition(5)
    wanted = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit(0))
    got = lexical_search.ranked(table, wanted, k, terms).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == search_by_brute_force(docs, items, k)


def test_search_without_rows(spark):
    items = spark.createDataFrame([(1, "one")], "item_id int, text string")
    assert lexical_search.ranked(empty_table(spark), items).collect() == []
    assert lexical_search.ranked(odd_table(spark), items.limit(0)).collect() == []
    assert len(lexical_search.ranked(odd_table(spark), items).collect()) == 2


def test_shared_sums_equal_plain_sums_with_fewer_additions():
    rng = random.Random(2)
    common = rng.sample(range(400), 60)
    items = [(i, sorted({*rng.sample(common, rng.randint(0, 50)), *rng.sample(range(400), 9)})) for i in range(70)]
    items.append((70, list(range(400))))
    for group in (64, 7):
        plan = lexical_search.mine(items, 400, group)
        columns = {t: (np.array(sorted(rng.sample(range(50), 20))), np.arange(20) * t) for t in range(0, 400, 2)}
        plain = {}
        for number, own in items:
            plain[number] = np.zeros(50, np.int64)
            for t in set(own) & set(columns):
                plain[number][columns[t][0]] += columns[t][1]
        got = dict(lexical_search.evaluate(plan, columns, 50))
        assert got.keys() == plain.keys() and all((got[i] == plain[i]).all() for i in got)
        assert len(plan.nodes) > 20
        assert plan.additions() < sum(len(own) for _, own in items)


# --- filter audit --------------------------------------------------------------------------------


def audit_by_brute_force(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for doc_id, source, text in docs:
        text = text or ""
        words = BLANK.findall(text)
        own = set()
        own |= {"A"} if len(words) < 200 else set()
        own |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        own |= {"D"} if re.search("[#$%&*|]", text) else set()
        same = [d for d, _, t in docs if (t or "") == text and d is not None]
        own |= {"E"} if doc_id is not None and min(same) < doc_id else set()
        fails.append((doc_id, source or "", own))
    out = {}
    for part in {p for _, p, _ in fails}:
        rows = [(d, f) for d, p, f in fails if p == part]
        removed_by = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [d for d, f in rows if name in f and not f & before]
                removed_by[name] += len(removed)
                out[part, order, step] = (
                    sum(not f & (before | {name}) for _, f in rows), len(removed),
                    sum(name in f and bool(f & before) for _, f in rows), sum(f == {name} for _, f in rows),
                    sum(d in good for d in removed), sum(d in toxic for d in removed),
                )
        for (p, order, step), figures in out.items():
            if p == part:
                out[p, order, step] = (*figures[:6], removed_by[order[step - 1]])
    return out


def audit_rows():
    rng = random.Random(4)
    docs = [(r[0], r[3], r[1]) for r in odd_rows()]
    texts = [prose(rng, n) + tail for n in (10, 250, 400) for tail in ("", " #", " ABCDEFGHIJ" * 12)] + ["x y " * 150, "É" * 9]
    docs += [(50 + i, rng.choice(["a", "b", "", None]), rng.choice(texts)) for i in range(120)]
    labels = [(50 + i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 130, 2)]
    return docs, [*labels, (None, 1, 1), (50, 1, 0), (50, 0, 1), (1, 1, 1)]


@pytest.mark.parametrize("bits", [64, 3])
def test_audit_equals_brute_force(spark, bits):
    """Also where nearly all texts share a hash: then whole texts decide."""
    docs, labels = audit_rows()
    table = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumns(
        {"mask": F.lit(7), "h": F.lit("x"), "least": F.lit(1)}
    )
    got = filter_audit.audit(
        table.repartition(5), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), bits
    ).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got} == audit_by_brute_force(docs, labels)


def test_audit_without_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(empty_table(spark), none).collect() == []
    assert filter_audit.audit(odd_table(spark), none).count() == 600 * len({r[3] or "" for r in odd_rows()})


def test_sketch_clears_unique_hashes_and_keeps_all_repeats(spark):
    values = [(i % 5000 if i < 400 else i,) for i in range(5000)] + [(i,) for i in range(300)]
    frame = spark.createDataFrame(values, "v bigint").select(F.xxhash64("v").alias("h"), "v").repartition(7)
    bits = filter_audit.cell_bits(len(values))
    bitmap = filter_audit.repeat_bitmap(frame, bits, flush=1000)
    found = {r.v for r in frame.where(filter_audit.maybe_repeated(frame, bitmap, bits)).collect()}
    assert set(range(300)) <= found and len(found) < 600


# --- token files ---------------------------------------------------------------------------------


def files_by_brute_force(docs, end=2):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe_ids.default_tokenizer())
    rows = [(d, array("I", [*tokenizer.encode(t or "", add_special_tokens=False).ids, end])) for d, t in docs]
    return rows


@pytest.mark.parametrize("block", [token_files.BLOCK, 700])
def test_token_files_round_trip(spark, tmp_path, block):
    docs = [(r[0], r[1]) for r in odd_rows()]
    table = odd_table(spark)
    path = str(tmp_path / "files")
    token_files.write_token_files(table, path, block=block, every=2)
    got = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
    want = files_by_brute_force(docs)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (d, len(ids), zlib.crc32(ids.tobytes())) for d, ids in want
    )
    assert [r.doc_id for r in got] == sorted((d for d, _ in want), key=lambda d: (d is None, d))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    pieces = sorted(token_files.pieces(spark, path, with_ids=True).collect(), key=lambda r: (r.part, r.at))
    by_doc = defaultdict(bytes)
    for p in pieces:
        by_doc[p.part, p.ordinal] += bytes(p.ids)
    assert Counter(by_doc.values()) == Counter(ids.tobytes() for _, ids in want)
    if block == 700:
        assert max(p.begun for p in pieces) > 20_000 and all(b.n <= block for b in token_files.read_blocks(spark, path).collect())


def test_token_files_without_rows(spark):
    assert token_files.round_trip(empty_table(spark)).collect() == []


def test_a_changed_byte_is_noticed(spark, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(odd_table(spark), path, block=5000)
    words = F.concat(F.expr("unhex('00')"), F.expr("substring(words, 2)"))
    broken = str(tmp_path / "broken")
    token_files.read_blocks(spark, path).withColumn("words", words).write.parquet(f"{broken}/blocks")
    spark.read.parquet(f"{path}/table").write.parquet(f"{broken}/table")
    with pytest.raises(Exception, match="checksum"):
        token_files.read_documents(spark, broken).collect()


def test_rans_from_every_checkpoint():
    rng = np.random.default_rng(3)
    values = rng.zipf(1.3, 200_000) % 3000
    table = rans.Table(*np.unique(values, return_counts=True), bits=14)
    assert int(table.frequency.sum()) == 1 << 14 and table.frequency.min() >= 1
    for n in (0, 1, 127, 128, 4000, 131_073):
        block = rans.encode(values[:n], table, every=8)
        assert (rans.decode(block, table) == values[:n]).all()
        for first in range(0, n, max(1, n // 9)):
            assert (rans.decode(block, table, first, first + 40) == values[first : min(n, first + 40)]).all()
    entropy = -sum(c * math.log2(c / len(values)) for c in np.unique(values, return_counts=True)[1]) / 8
    block = rans.encode(values, table)
    assert len(block.words) < 1.02 * entropy
    with pytest.raises(ValueError, match="frequency"):
        rans.encode(np.array([3001]), table)
    only = rans.Table(np.array([7]), np.array([5]))
    assert (rans.decode(rans.encode(np.full(1000, 7), only), only) == 7).all()


def test_joined_checksums():
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (0, 1, 5, 4096, 100_003)]
    assert token_files.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_word_by_word_ids_equal_the_tokenizer():
    rng = random.Random(5)
    ids = bpe_ids.ByteBpe(bpe_ids.default_tokenizer(), most_words=50)
    parts = ["a", "B", "the", " ", " ", " ", "\n", "\t", "'s", "'", "é", "ß", "中", "9", "12", "!", ".", "<|endoftext|>", "<|",
             "\r", "\x1c", "\x85", "　", "ª", "①", "é", "🙂", "Ⅷ"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert ids.of(text) == ids._encode(text), repr(text)
    assert len(ids.words) <= 50


# --- secrets -------------------------------------------------------------------------------------


def test_context_words_take_linear_time():
    for text in ("token " * 200_000, "token" * 200_000, "token " + "x" * 2_000_000):
        start = time.perf_counter()
        secrets.scan(text)
        assert time.perf_counter() - start < 2


def test_keys_that_only_novelty_finds(spark):
    """Keys without a label of the fixed patterns, words and names beside context words, and base
    spans with their novelty."""
    rng = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choices(alphabet, k=n)) + "7x" for n in (20, 32, 64, 200)]
    rows = [(i, f"{prose(rng, 30)} the credential was {key} as of {prose(rng, 30)}") for i, key in enumerate(keys)]
    rows += [(10, "private key file config_settings_default_2example and so on"), (11, "signature: 12345678901234567890aaaaaaaa")]
    rows += [(12, 'password = "correcthorse9"'), (13, 'password = "abcdefghijklmnopqrstuvwxyz"'), (14, None)]
    got = {r.doc_id: r for r in secrets.scanned(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for (i, text), key in zip(rows, keys, strict=False):
        start = text.index(key)
        assert got[i].spans == f"novel:{start}:{start + len(key)}" and got[i].novelty[0] >= 0.8
    assert [got[i].n_novel for i in (10, 11, 12, 13, 14)] == [0] * 5
    assert got[12].novelty[0] > got[13].novelty[0] and got[14].novelty == []
