"""BPE, decontamination, line dedup and SimHash against brute force on small and awkward tables."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlake.llm import bpe, decontaminate, line_dedup, simhash

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `n_words` string, `token.ids` int"
LINE = "This line is long enough to be a key of forty code points"
TEXTS = [
    None,
    "",
    " \n\t\n",
    "a b c",
    f"{LINE}\nown line one\n  {LINE.upper()}\t\n",
    f"x\n{LINE}",
    f"{LINE}\r\n",
    f"é {LINE}\n{LINE}",
    LINE,
    f"{LINE}\nÄ",
    "the quick brown fox jumps over the lazy dog and runs away again " * 40,
    "the quick brown fox jumps over the lazy dog and runs away again " * 40,
    "the quick brown fox jumps over the lazy dog and runs away Again. " * 40,
    "zero one two three four five six seven eight nine ten eleven",
    "one, two; THREE four five six seven eight nine ten! tail",
    "x" * 30_000,
    "short item",
    "<|endoftext|> \u0000 \U0001f600 日本語 ſK",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "src0", None, "clash", 1) for i, t in enumerate(TEXTS)]
    rows += [(None, LINE, "en", None, 3, None, None), (3, "a b c", None, None, None, None, None), (3, "a b c", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_query(docs, encoding):
    rows = bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == docs.count()
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = encoding.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    apart = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in apart.collect())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aeinorst dhl'", max_size=200), st.text(alphabet="ab", max_size=300), st.text(alphabet="-=*_ .", max_size=200)))
def test_bpe_is_tiktoken(text):
    codec = bpe.text_codec(PATH, public_tokenizers.PATTERN)
    enc = _encoding()
    packed = codec.encode(text)
    assert packed == b"".join(i.to_bytes(4, "little") for i in enc.encode_ordinary(text))
    assert bpe.decoder(PATH).decode(packed) == text.encode()


_made = []


def _encoding():
    if not _made:
        _made.append(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={}))
    return _made[0]


def test_every_token_encodes_to_itself_and_random_bytes_agree():
    codec, enc = bpe.text_codec(PATH, public_tokenizers.PATTERN).codec, _encoding()
    rng = random.Random(1)
    tokens = list(codec.tokens.values())
    for _ in range(4000):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 4)))
        assert codec.encode_piece(piece) == enc._encode_single_piece(piece), piece


def brute_hits(text, items, window=10):
    def words(t):
        out, cur = [], ""
        for ch in t or "":
            o = ord(ch)
            if o <= 0x2F or 0x3A <= o <= 0x40 or 0x5B <= o <= 0x60 or 0x7B <= o <= 0x7F:
                if cur:
                    out.append(cur)
                cur = ""
            else:
                cur += chr(o + 32) if 0x41 <= o <= 0x5A else ch
        return out + [cur] if cur else out

    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(window, len(x))
        for s in range(len(x) - n + 1 if x else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


ITEMS = [
    (1, "One two three four five six seven eight nine ten ELEVEN"),
    (2, "one two three four five six seven eight nine ten"),
    (10, "short ITEM"),
    (3, "c"),
    (4, None),
    (5, "..."),
    (2, "quick brown fox jumps over the lazy dog and runs away"),
    (7, "日本語 ſK"),
]


def test_decontamination_in_blocks_by_another_column(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    other = docs.withColumnRenamed("text", "body").withColumn("text", F.lit("clean"))
    want = sorted(str(r.doc_id) for r in decontaminate.remove_contaminated(docs, bench).collect())
    kept = decontaminate.remove_contaminated(other, bench, text="body", block_bytes=60)
    assert kept.columns == other.columns and sorted(str(r.doc_id) for r in kept.collect()) == want
    found = decontaminate.find_contamination(docs.withColumn("N_HIT", F.lit("clash")), bench, block_bytes=60)
    assert [c.lower() for c in found.columns] == [c for c in docs.columns if c not in ("n_hit", "n_words")] + ["n_words", "n_hit", "spans", "matches"]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, docs, block_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    full = decontaminate.find_contamination(docs.select("doc_id", "text"), bench, block_bytes=block_bytes)
    for r in full.collect():
        n, hit, items = brute_hits(r.text, ITEMS)
        assert (r.n_words, r.n_hit, sorted({m.item_id for m in r.matches})) == (n, hit, items), r
        if block_bytes > 100 and r.doc_id == 13:
            assert max(m.n_words for m in r.matches) == 11
    if block_bytes > 100:
        rows = decontaminate.digests(docs, bench).collect()
        assert len(rows) == docs.count()
        kept = decontaminate.remove_contaminated(docs, bench)
        assert kept.columns == docs.columns and kept.count() == sum(not r.contaminated for r in rows)


def test_items_without_an_id_are_matched(spark):
    bench = spark.createDataFrame([(None, "one two three four five six"), (7, "a b c")], "item_id long, text string")
    df = spark.createDataFrame([(1, "zero one two three four five six"), (2, "x a b c"), (3, "clean")], "doc_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.digests(df, bench).collect()}
    assert [(rows[i].contaminated, rows[i].n_hit, rows[i].n_items) for i in (1, 2, 3)] == [(True, 6, 0), (True, 3, 1), (False, 0, 0)]
    assert rows[1].items_sha256 == rows[3].items_sha256 and rows[1].longest_match == 6
    assert [r.doc_id for r in decontaminate.remove_contaminated(df, bench).collect()] == [3]


def test_decontamination_empty(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.digests(docs, empty).collect()} == {0}
    assert decontaminate.digests(docs.limit(0), empty).count() == 0


def test_decontamination_random(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, text(rng.randint(1, 6))) for i in range(12)]
    docs = spark.createDataFrame([(i, text(rng.randint(0, 60))) for i in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.find_contamination(docs, bench, window=4).collect():
        n, hit, found = brute_hits(r.text, items, 4)
        assert (r.n_words, r.n_hit, sorted({m.item_id for m in r.matches})) == (n, hit, found)


def test_line_dedup(docs):
    def key(line):
        s = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)

    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    holders = {}
    for i, t in rows:
        for line in t.split("\n"):
            if i is not None and len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    common = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    assert common
    want = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if i is None or common.get(key(x), i) == i]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = [tuple(r) for r in line_dedup.digests(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    out = line_dedup.drop_common_lines(docs)
    assert [c for c in out.columns if c not in ("n_lines", "n_dropped")] == docs.columns
    assert line_dedup.digests(docs.limit(0)).count() == 0


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = {i: i for i in range(len(fps))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_query(docs):
    rows = simhash.digests(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [brute_fingerprint(t) for _, t in texts]
    root = brute_components(fps)
    least = {}
    for (i, _), c in zip(texts, root):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(texts, fps, root)), key=str)
    assert sorted(map(tuple, rows), key=str) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == set(least.values()) - {None}
    assert simhash.digests(docs.limit(0)).count() == 0


def test_near_duplicates_by_row(spark):
    """Repeated ids, equal rows, rows without an id: one row of each group, whatever its id's other rows do."""
    copy, own, far = "one two three four five six", "quite another text of its own words", "nobody else says this at all here"
    rows = [(2, copy, "a"), (5, own, "b"), (5, copy, "c"), (5, own, "d"), (5, own, "b"), (None, copy, "e"), (None, far, "f"), (None, far, "g"), (7, None, "h"), (8, "", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(df).collect()]
    assert sorted(kept, key=str) == sorted([(2, copy), (5, own), (None, far), (7, None)], key=str)
    rng = random.Random(3)
    for _ in range(3):
        words = "alpha beta gamma delta epsilon zeta eta".split()
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(12)]
        rows = [(rng.choice([None, *range(8)]), rng.choice(texts)) for _ in range(60)]
        got = [tuple(r) for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        root = brute_components([brute_fingerprint(t) for _, t in rows])
        groups = {}
        for r, c in zip(rows, root):
            groups.setdefault(c, set()).add(r)
        group_of = {r: c for c, g in groups.items() for r in g}
        assert len(got) == len(groups) and {group_of[r] for r in got} == groups.keys()
        least = lambda g: min((i for i, _ in g if i is not None), default=None)
        assert all(i == least(groups[group_of[i, t]]) for i, t in got)


def test_simhash_links_are_complete(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(300):
        f = rng.choice(fps)
        for _ in range(rng.randint(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    got = [roots.get(f, f) for f in fps]
    want = brute_components([f & (1 << 64) - 1 for f in fps])
    pairs = {(a, b) for a, b in zip(got, want)}
    assert len(pairs) == len(set(got)) == len(set(want))
