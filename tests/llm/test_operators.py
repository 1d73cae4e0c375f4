"""Every operator on odd rows, on an empty table, and against a brute-force version."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sugarline.llm import (
    fingerprints, language, mixing, near_duplicates, packing, quality_model, quality_rules, repeats, secrets, tokens,
)
from tests.llm.texts import empty_table, odd_rows, odd_table, prose, unique_prose

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def labels(spark, rows=((1, 1), (2, 0), (3, 1), (None, 1), (7, None), (7, 0), (9, 1), (12, 0))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int")


def operators(spark):
    return {
        "language": language.predicted,
        "near_duplicates": near_duplicates.near_duplicates,
        "representatives": near_duplicates.representatives,
        "secrets": secrets.scanned,
        "packing": packing.packed,
        "quality_rules": quality_rules.judged,
        "tokens": tokens.counted,
        "mixing": mixing.mix,
        "mixed_documents": mixing.mixed_documents,
        "quality_model": lambda d: quality_model.predicted(d, labels(spark)),
        "accepted": lambda d: quality_model.accepted(d, labels(spark)),
        "fingerprints": fingerprints.compared,
        "repeats": repeats.without_repeats,
    }


NAMES = [
    "language", "near_duplicates", "representatives", "secrets", "packing", "quality_rules", "tokens", "mixing",
    "mixed_documents", "quality_model", "accepted", "fingerprints", "repeats",
]
#: Operators that return a row for each row they get.
ROW_FOR_ROW = set(NAMES) - {"representatives", "packing", "mixed_documents", "accepted"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    table = odd_table(spark)
    rows = operators(spark)[name](table).collect()
    if name in ROW_FOR_ROW:
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows())
    if name in ("representatives", "mixed_documents", "accepted"):
        assert operators(spark)[name](table).columns == table.columns


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, name):
    assert operators(spark)[name](empty_table(spark)).collect() == []


def shingles(text):
    words = [w.lower() for w in BLANK.findall(text or "")]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups_by_brute_force(rows):
    """Group of each row index: links of similar sets and of equal doc_ids."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            near = sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j])
            if near or (rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], sets


def near_rows():
    """Chains of texts that drift apart, large groups of copies, and a passage many texts share."""
    rng = random.Random(3)
    rows = [(r[0], r[1]) for r in odd_rows()]
    at = 100
    for _ in range(6):
        words = unique_prose(rng, 120).split()
        for _ in range(12):
            rows.append((at, " ".join(words)))
            at += 1
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = unique_prose(rng, 1)
    shared = unique_prose(rng, 60)
    for _ in range(60):
        rows.append((at, f"{unique_prose(rng, rng.randint(1, 60))} {shared} {unique_prose(rng, rng.randint(0, 12))}"))
        at += 1
    copy = unique_prose(rng, 80)
    rows += [(at + k, copy) for k in range(50)]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    group, sets = groups_by_brute_force(rows)
    smallest = defaultdict(list)
    for (doc_id, _), g in zip(rows, group, strict=True):
        if doc_id is not None:
            smallest[g].append(doc_id)
    want = Counter(
        (d, len(s), min(smallest[g], default=None) if s else d) for (d, _), s, g in zip(rows, sets, group, strict=True)
    )
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = near_duplicates.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_repeated_rows_and_ids_keep_their_links(spark):
    rng = random.Random(21)
    rows = []
    for k in range(40):
        words = unique_prose(rng, 104).split()
        other = " ".join(words[:94] + unique_prose(rng, 10).split())  # 90 of 100 shingles in common
        rows += [(10 * k + 5, " ".join(words))] * (2 + k % 3) + [(10 * k + 7, other)] * (1 + k % 2)
    # Ids with several texts, some of which are known by a smaller id and have partners
    for k in range(1000, 1300, 10):
        words = [unique_prose(rng, 104).split() for _ in range(3)]
        near = [" ".join(w[:94] + unique_prose(rng, 10).split()) for w in words]
        rows += [(k + 3, " ".join(w)) for w in words] + [(k + 4 + i, t) for i, t in enumerate(near)]
        rows += [(k + 1, " ".join(words[0])), (k + 3, " ".join(words[1]).upper()), (k + 8, near[2])] * (k % 20 // 10)
    group, sets = groups_by_brute_force(rows)
    smallest = {g: min(r[0] for r, h in zip(rows, group, strict=True) if g == h) for g in set(group)}
    want = Counter((d, smallest[g]) for (d, _), g in zip(rows, group, strict=True))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
        got = near_duplicates.near_duplicates(docs).collect()
        kept = near_duplicates.representatives(docs).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert Counter((r.doc_id, r.component_id) for r in got) == want
    assert sorted(r.doc_id for r in kept) == sorted(smallest.values())


def test_representatives_keep_one_of_each_group(spark):
    rows = near_rows()
    group, sets = groups_by_brute_force(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = [(r.doc_id, r.text) for r in near_duplicates.representatives(docs).collect()]
    place = {r: i for i, r in reversed(list(enumerate(rows)))}
    kept = [group[place[r]] for r in got if shingles(r[1])]
    assert sorted(kept) == sorted({g for g, s in zip(group, sets, strict=True) if s})
    assert sum(not shingles(t) for _, t in got) == sum(not s for s in sets)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(500, 400)]
    got = near_duplicates.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    want = {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {500: 400, 400: 400}
    assert {r.node: r.root for r in got} == want


def test_repeats_equal_brute_force(spark):
    rng = random.Random(9)
    shared, other = unique_prose(rng, 40), unique_prose(rng, 12)
    texts = [None, "", "x" * 130, "ab" * 90, unique_prose(rng, 30)]
    texts += [unique_prose(rng, 5) + shared[rng.randint(0, 40) :] + unique_prose(rng, 3) for _ in range(12)]
    texts += [other + unique_prose(rng, 6) + other, "é" * 70 + other, texts[4], texts[4][:120]]
    texts += [shared.replace("a", "ß")] * 3
    size = 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in repeats.without_repeats(docs, size=size, gram=16).collect()}
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    for doc_id, d in enumerate(data):
        gone = [False] * len(d)
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(d), sum(gone), spans, kept)


def test_passages_of_over_50_words_that_texts_share_are_shown(spark):
    """Passages with fewer bytes than the strings that are removed; checked by brute force."""
    rng = random.Random(12)

    def words(n):
        return unique_prose(rng, n).split()

    passage, short, edge, inside = words(51), words(50), words(70), words(55)
    lists = [words(rng.randint(0, 60)) + passage + words(rng.randint(0, 60)) for _ in range(12)]
    lists += [words(40) + short + words(40) for _ in range(6)]
    lists += [words(20) + edge[k : k + 60] + words(20) for k in (0, 4, 9, 10, 3)]
    lists += [words(20) + inside + words(9) + inside + words(20), words(120), words(30), passage, passage[1:], []]
    copy = words(51)
    lists += [copy, copy, *[words(50)] * 2, words(10) + [w.upper() for w in passage]]
    texts = [rng.choice([" ", "\n"]).join(w) for w in lists] + [None, lists[0][0], " \t\n"]
    texts += ["é" * 200 + " " + " ".join(passage) + " ß", "x".join(passage)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = repeats.without_repeats(docs).collect()
    split = [BLANK.findall(t or "") for t in texts]
    runs = [{tuple(w[i : i + 51]) for i in range(len(w) - 50)} for w in split]
    want = {i for i, r in enumerate(runs) if any(r & other for j, other in enumerate(runs) if i != j)}
    assert {r.doc_id for r in rows if r.shares_passage} == want
    assert want == {*range(12), *range(18, 23), 26, 29, 30, 37}
    # The contract's strings of 400 bytes alone are removed
    assert {r.doc_id for r in rows if r.n_removed and r.shares_passage} < want


def test_word_hashes_do_not_depend_on_place_and_block():
    text = " eins zwei  drei\tzw\u00f6lf eins " + "lang" * 20 + "\nzwei x" + "lang" * 20
    whole = repeats.word_hashes(text.encode())
    names = BLANK.findall(text)
    assert len(whole) == len(names) and len(set(whole.tolist())) == len(set(names))
    assert whole[0] == whole[names.index("eins", 1)] == repeats.word_hashes(b"eins")[0]
    for block in (16, 40):
        hashes = repeats.word_hashes(text.encode(), block)
        assert [a == b for a, b in zip(hashes, whole, strict=True)] == [len(w.encode()) <= block for w in names]
    assert len(repeats.word_hashes(b"")) == len(repeats.word_hashes(b" \n")) == 0


def test_large_anchors_are_merged_by_binary_search():
    from sugarline.llm.suffixes import Shard

    rng = random.Random(2)
    base = bytes(rng.choices(b"ab", k=80))
    parts = [base[i : i + 40] + bytes(rng.choices(b"abc", k=8)) for i in (rng.randint(0, 30) for _ in range(12))]
    rows = [(1, k, p) for k, p in enumerate(parts)]
    for size in (3, 11):
        whole = Shard(parts, size).intervals()
        for shard_bytes in (30, 150, 10_000):
            got = defaultdict(list)
            for batch in repeats._merged(rows, size, shard_bytes):
                for r in batch.to_pylist():
                    got[r["content"]].append((r["first"], r["past"]))
            assert [got[k] for k in range(len(parts))] == whole


def test_suffix_array_and_prefixes():
    from sugarline.llm.suffixes import Segments, neighbour_prefixes, suffix_array

    rng = random.Random(4)
    for _ in range(60):
        letters = rng.choice([b"a", b"ab", b"a\0b", bytes(range(256))])
        parts = [bytes(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        s = Segments(parts)
        sa = suffix_array(s)
        ordered = [s.data[p : p + s.left[p]].tobytes() for p in sa]
        assert ordered == sorted(ordered)
        prefixes = neighbour_prefixes(s, sa)
        for i in range(1, len(sa)):
            x, y = ordered[i - 1], ordered[i]
            same = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert prefixes[i] == same


def test_packing_is_whole_and_tight(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(i, r[1]) for i, r in enumerate(odd_rows())]
    rows += [(50, "A <|endoftext|> b <|ENDOFTEXT|> it's 12.5%!"), (51, "ÀÉ ñ z\x1cq")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    pieces = packing.packed(docs).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    filled = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 2048
    assert sum(2048 - n for n in filled.values() if n & (n - 1)) <= 0.01 * sum(filled.values())


def test_classes_take_a_fixed_number_of_pieces():
    bins = packing.Bins(capacity=64, least=8, most_padding=4)
    rng = random.Random(1)
    lengths = [rng.randint(1, 200) for _ in range(300)]
    for i, n in enumerate(lengths):
        bins.add(i, b"\0\0\0\0" * n)
        assert all(len(held) < k for k, held in bins.open.items())
        assert all(64 // (k + 1) < len(p[2]) // 4 <= 64 // k for k, held in bins.open.items() for p in held)
    bins.finish()
    got = Counter()
    for r in bins.rows:
        got[r[0]] += r[2]
    assert [got[i] for i in range(300)] == lengths


def test_token_counts_follow_edits(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = tokens.word_ids(path)
    rng = random.Random(8)
    for start in ["", "x", prose(rng, 40), "  lead and trail \n", prose(rng, 400, "fr"), "it's <|endoftext|>now"]:
        tree, text = tokens.TokenTree(start, ids), start
        for _ in range(30):
            a = rng.randint(0, len(text))
            b = rng.randint(a, min(len(text), a + 30))
            new = rng.choice(["", " ", "new word", "glue", "\n\n", "it's"])
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.length == len(text)
            assert tree.total == len(tokenizer.encode(text, add_special_tokens=False).ids)
    tree = tokens.TokenTree(prose(rng, 5000), ids)
    tree.edit(10_000, 10_010, "a few words")
    assert tree.reencoded < 10


def test_base_secrets_equal_plain_matching(spark):
    rng = random.Random(6)
    parts = ["password", "API-KEY", "api_key", "token", "secret", "=", ":", " ", "  ", "\"", "abcdef", "secret=token = abcdef",
             "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0123456789abcdef", "\n", "é", "x9", "ſecret=abcdefg"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(300)]
    assign = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    for text in texts:
        want = [("assign", *m.span()) for m in re.finditer(assign, text) if len(m[1]) >= 6]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base, spans = secrets.scan(text)
        assert sorted(base) == sorted(want) and set(base) <= set(spans)
    row = secrets.scanned(spark.createDataFrame([(1, "token: abcdefg")], "doc_id bigint, text string")).first()
    assert row.spans == "assign:0:14" and row.base_sha256 == hashlib.sha256(b"assign:0:14").hexdigest()


def test_novel_secrets_are_found_and_words_are_not():
    key = "q7Rz0Lw2Vx9Kp4Tn8Yb3Hs6Mf1Jd5Gc"
    text = f"the bearer credential is {key} for now"
    assert [text[a:b] for k, a, b in secrets.scan(text)[1] if k == "novel"] == [key]
    assert secrets.redact(text, secrets.scan(text)[1]) == "the bearer credential is [secret] for now"
    for plain in (
        f"unrelated words {key}",
        "the secret is internationalisation and responsibilities",
        "credential client_secret_value_1 username_user_id_2",
        f"{key} {key} the bearer credential is {key}",
    ):
        assert not [s for s in secrets.scan(plain)[1] if s[0] == "novel"]


@pytest.mark.parametrize(
    "letters", ["0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
)
@pytest.mark.parametrize("size", [32, 64, 128, 256, 1024, 20_000])
def test_random_keys_of_any_alphabet_and_length_are_found(letters, size):
    rng = random.Random(size)
    for _ in range(5):
        key = "".join(rng.choices(letters, k=size))
        text = f"the signature: {key} for now"
        assert [text[a:b] for _, a, b in secrets.scan(text)[1]] == [key]
    for plain in ("wxy1" * (size // 4), "client_secret_value_1" * (size // 21 + 1), "A" * size + "1"):
        assert secrets.scan(f"the signature: {plain} for now")[1] == []


def test_repeated_keys_in_a_context_are_found():
    rng = random.Random(5)
    for size in (20, 32, 64, 200, 600):
        key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=size))
        for text in (f"bearer {key}\nand again bearer {key}", f"token={key} and the bearer {key} {unique_prose(rng, 9)} signature {key}"):
            assert [text[a:b][-size:] for _, a, b in secrets.scan(text)[1]] == [key] * text.count(key)


def test_rules_do_not_depend_on_their_order(spark):
    docs = odd_table(spark)
    rules = quality_rules.RULES
    one = {(r.doc_id, r.n_words): r.kept for r in quality_rules.judged(docs, rules).collect()}
    two = {(r.doc_id, r.n_words): r.kept for r in quality_rules.judged(docs, rules[::-1]).collect()}
    assert one == two


def test_repeated_words_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 30))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in quality_rules.judged(docs, ()).collect():
        w = texts[r.doc_id].split()
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert r.n_repeat_words == len(hit)


def test_winnowing_keeps_its_guarantee(spark):
    rng = random.Random(12)
    shared = unique_prose(rng, fingerprints.GRAM + fingerprints.WINDOW - 1)
    rows = [(i, f"{unique_prose(rng, rng.randint(0, 30))} {shared} {unique_prose(rng, rng.randint(0, 30))}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [set(r.p.hash) for r in docs.select(fingerprints.winnow(docs["text"]).alias("p")).collect()]
    assert all(a & b for a in found for b in found)


def test_winnowing_equals_brute_force(spark):
    rng = random.Random(13)
    texts = [" ".join(rng.choices(["a", "b", "c"], k=n)) for n in (0, 1, 2, 3, 5, 8, 9, 40, 100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in docs.select("doc_id", fingerprints.winnow(docs["text"]).alias("p")).collect():
        words = texts[row.doc_id].split()
        grams = [tuple(words[i : i + fingerprints.GRAM]) for i in range(max(len(words) - fingerprints.GRAM + 1, min(1, len(words))))]
        value = dict(zip(row.p.place, row.p.hash, strict=True))
        hash_of = {grams[p]: h for p, h in value.items()}
        assert len(value) == len(row.p.hash) and all(hash_of[grams[p]] == h for p, h in value.items())
        # Every window holds a selected place, and equal grams compete by place: the rightmost wins
        for i in range(max(len(grams) - fingerprints.WINDOW + 1, min(1, len(grams)))):
            window = range(i, min(i + fingerprints.WINDOW, len(grams)))
            inside = [p for p in window if p in value]
            assert inside
            best = min(inside, key=lambda p: (value[p] >> fingerprints.PLACE_BITS, -p))
            assert best == max(p for p in window if grams[p] == grams[best])


def test_next_documents_and_edited_texts(spark):
    rng = random.Random(14)
    rows = [(i * 7 % 101 * 10**9, prose(rng, rng.randint(0, 30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in fingerprints.compared(docs).collect()}
    ordered = sorted(rows)
    for (doc_id, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert got[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[doc_id].near_next <= 1 and 0 <= got[doc_id].near_edited <= 1


def test_mixture_meets_its_targets(spark):
    rng = random.Random(15)
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choice("abcde")) for i in range(400)]
    rows += [(1000 + i, prose(rng, 30), None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    source = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.taken <= 2 * r.size
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    order = [*"abcde", None]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    left, open_, want = 1.5 * sum(size.values()), dict(zip(order, [5, 2, 1, 5, 2, 1], strict=True)), {}
    while open_:
        share = left / sum(open_.values())
        full = [s for s, w in open_.items() if share * w > 2 * size[s]]
        for s in full or list(open_):
            want[s] = 2 * size[s] if full else share * open_[s]
            left -= want[s] if full else 0
            del open_[s]
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 1
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == sorted(map(tuple, got))
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert all(n in (1, 2) for n in mixed.values())


@pytest.mark.parametrize("classes", [0, 1, 2, 3, 5, 6, 12, 40])
def test_codewords_differ(classes):
    code = language.codewords(classes)
    assert len({tuple(row) for row in code.tolist()}) == classes
    if classes > 2:
        distances = [(code[i] != code[j]).sum() for i in range(classes) for j in range(i)]
        assert min(distances) >= 2


def test_language_on_texts_it_has_not_seen(spark):
    rng = random.Random(16)
    rows = [(i, prose(rng, rng.randint(5, 60), lang), lang) for i in range(300) for lang in [rng.choice(["en", "fr"])]]
    rows += [(900, "12 34 %", "en"), (901, None, "fr"), (902, "walks under the stones", None)]
    got = {r.doc_id: r for r in language.predicted(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    for doc_id, text, lang in rows[:300]:
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert got[doc_id].lang_pred == lang and 0 <= got[doc_id].score <= 1
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und", "und", "en"]


def test_quality_model_on_texts_it_has_not_seen(spark):
    rng = random.Random(17)
    good = [(i, prose(rng, rng.randint(30, 90)), 1) for i in range(200)]
    bad = [(200 + i, " ".join([unique_prose(rng, 1) + "%%%"] * 40), 0) for i in range(100)]
    docs = spark.createDataFrame([r[:2] for r in good + bad], "doc_id bigint, text string")
    known = spark.createDataFrame([(r[0], r[2]) for r in good + bad], "doc_id bigint, quality int")
    for r in quality_model.predicted(docs, known).collect():
        assert r.predicted == (r.doc_id < 200) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    kept = quality_model.accepted(docs, known).collect()
    assert {r.doc_id for r in kept} == set(range(200))


def test_frequent_tokens_are_counted_like_others(spark):
    rng = random.Random(18)
    rows = [(i, 20, sorted(rng.sample(range(-(2**62), 2**62, 2**57), 20))) for i in range(50)]
    sets = spark.createDataFrame(rows, "id bigint, n bigint, tokens array<bigint>").repartition(3)
    df = Counter(t for r in rows for t in r[2])
    for often in (2, 5, 1000):
        got = near_duplicates.shared_tokens(sets, often, piece=7).collect()
        assert Counter(r.df for r in got) == Counter(df[t] for r in rows for t in r[2] if df[t] > 1)
        assert len({(r.id, r.token) for r in got}) == len(got)
