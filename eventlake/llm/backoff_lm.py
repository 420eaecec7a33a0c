"""Language-model scoring with a weighted backoff automaton.

States are the contexts of smoothed n-grams.  A state's arc for a word that
follows its context in training has the smoothed probability of that n-gram;
every other word takes the failure arc to the state of the context without its
first word, and pays the arc's weight.  A text is one left-to-right traversal
that carries the state and adds up log-probabilities.

Smoothing is the Dirichlet prior of MacKay and Peto, by orders:

    P(w | h) = (c(h w) + m P(w | h')) / (c(h) + m),    m = A c(h)^B

The prior's weight m grows as the number of different words after a context
does, by Heaps' law, so a rare context that always goes on alike is trusted
sooner than a frequent one that goes on anyhow.  An n-gram that training lacks
has exactly P(w | h') times the failure weight m / (c(h) + m), and all
probabilities of a state sum to one.

The model grows with the corpus, so no machine holds it.  Documents are packed
into blocks as they lie; a block asks for the counts of the n-grams in its own
text, packed by shard of the n-gram space, those shards only that it has
n-grams of; a shard adds up what all blocks counted and answers each block.  A
frequent n-gram is asked for once by a block, so no key is hot.  What comes back
is the part of the automaton that the block's texts can reach.
"""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder

#: Words of an n-gram, and A and B of the prior's weight.
ORDER, PRIOR = 3, (5.0, 0.85)
#: Remainder of crc32(doc_id) mod 5 of the rows that are held out.
FOLDS, HELD_OUT = 5, 1
#: Text of a block, and n-grams of a shard: both bound a task's memory.
BLOCK_BYTES, SHARD_GRAMS = 16 << 20, 4_000_000
#: Most tasks of a stage; beyond, a task takes several blocks or shards, one after the other.
MOST_TASKS = 20_000
#: The end of a text, and its beginning, as keys no word's hash is taken for.
END, BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Bits of a word's key and of a longer n-gram's: fewer save a byte of each that moves.
WORD_BITS, GRAM_BITS = 64, 56
#: Tokens of a lane: the traversal walks all lanes of a block abreast, and longer texts are several.
LANE = 1024


def block_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, each token's word, each word's 64-bit key): words with A-Z lower-cased, and the end of each text."""
    import xxhash

    folded = pc.ascii_lower(texts.cast(pa.large_string()))
    lists = pc.ascii_split_whitespace(folded)
    offsets = lists.offsets.to_numpy()
    words = lists.values
    real = pc.binary_length(words).to_numpy() > 0
    upto = np.concatenate(([0], np.cumsum(real)))[offsets]
    sizes = np.diff(upto) + 1
    coded = words.filter(pa.array(real)).dictionary_encode()
    ends = np.frombuffer(coded.dictionary.buffers()[1], np.int64, len(coded.dictionary) + 1).tolist()
    data = memoryview(coded.dictionary.buffers()[2] or b"")
    keys = np.fromiter((xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(ends, ends[1:])), np.uint64, len(ends) - 1)
    word = np.full(int(sizes.sum()), len(keys), np.int32)
    end = np.zeros(len(word), bool)
    end[np.cumsum(sizes) - 1] = True
    word[~end] = coded.indices.to_numpy()
    return sizes, word, np.append(keys, END)


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of contexts h followed by words w."""
    x = (h ^ (h >> np.uint64(31))) * _MIX + w
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


def gram_keys(tokens: np.ndarray, at: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For each order from 2 on the key of the n-gram that ends at each token; ``at``: places of the tokens in their texts, which begin marks precede."""

    def before(j: int) -> np.ndarray:
        if j == 0:
            return tokens
        shifted = np.full(len(tokens), BEGIN, np.uint64)
        shifted[j:] = tokens[:-j]
        shifted[at < j] = BEGIN
        return shifted

    for k in range(2, order + 1):
        key = before(k - 1)
        for j in range(k - 2, -1, -1):
            key = _mixed(key, before(j))
        yield key >> np.uint64(64 - GRAM_BITS)


def _packed(values: np.ndarray) -> bytes:
    """Unsigned counts, deflated: a byte each, for most are 0 or 1; those from 255 on follow in full."""
    large = values[values >= 255].astype("<u8")
    return len(values).to_bytes(8, "little") + zlib.compress(np.minimum(values, 255).astype(np.uint8).tobytes() + large.tobytes(), 4)


def _unpacked(blob: bytes) -> np.ndarray:
    data, n = zlib.decompress(blob[8:]), int.from_bytes(blob[:8], "little")
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n)
    return out


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the first and the steps to the next, each in as many bytes as the largest step takes."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked_keys(blob: bytes) -> np.ndarray:
    if len(blob) == 1:
        return np.zeros(0, np.uint64)
    width = blob[0]
    steps = np.zeros(((len(blob) - 9) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(np.concatenate([np.frombuffer(blob[1:9], np.uint64), steps.view(np.uint64).reshape(-1)]), dtype=np.uint64)


def _bits(k: int) -> int:
    return WORD_BITS if k == 1 else GRAM_BITS


def _shard_bounds(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Where each shard's sorted keys begin and end: shards are ranges of the key space."""
    edges = [(k << bits) // shards for k in range(1, shards)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]))


def _begin_keys(order: int) -> Iterator[np.ndarray]:
    """Keys of the contexts of 2, 3, ... begin marks."""
    return (k[-1:] for k in gram_keys(np.full(order, BEGIN, np.uint64), np.arange(order), order))


def sorting(key: np.ndarray, bits: int) -> np.ndarray:
    """argsort of keys below 2 to the power of ``bits``: a plain sort of their top bits with the places below them, then what these leave open."""
    low = max(1, len(key).bit_length())
    cut = max(0, bits - (64 - low))
    packed = (key.astype(np.uint64) >> np.uint64(cut)) << np.uint64(low) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    by = (packed & np.uint64((1 << low) - 1)).astype(np.int64)
    if cut:
        packed >>= np.uint64(low)
        found = key[by]
        for at in np.flatnonzero(found[1:] < found[:-1]).tolist():
            same = slice(*np.searchsorted(packed, packed[at : at + 1].repeat(2) + np.array([0, 1], np.uint64)).tolist())
            by[same] = by[same][np.argsort(key[by[same]], kind="stable")]
    return by


def _ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, place of each key in them)."""
    by = sorting(key, bits)
    key = key[by]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    place = np.empty(len(key), np.int32)
    place[by] = np.cumsum(new, dtype=np.int32) - 1
    return key[new], place


class BlockGrams:
    """A block's sorted distinct n-grams of each order, and each token's place in them.

    The keys of order k also have the context of k begin marks, at ``marks[k - 1]``;
    ``distinct`` counts them, for those who don't need the longer n-grams' keys.
    """

    def __init__(self, texts: pa.Array, order: int, keys_too: bool = True):
        self.order = order
        self.sizes, word, keys = block_tokens(texts)
        self.starts = np.cumsum(self.sizes) - self.sizes
        flat = keys[word]
        at = np.arange(len(flat), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.sizes)
        distinct, place = _ranked(np.append(keys, BEGIN), WORD_BITS)
        self.keys, self.places, self.marks, self.distinct = [distinct], [place[word]], [int(place[-1])], [len(distinct)]
        for key, mark in zip(gram_keys(flat, at, order), _begin_keys(order)):
            distinct, place = _ranked(np.append(key, mark), GRAM_BITS)
            self.distinct.append(len(distinct))
            if keys_too:
                self.keys.append(distinct)
            self.places.append(place[:-1])
            self.marks.append(int(place[-1]))

    def counted(self, trained: np.ndarray) -> list[np.ndarray]:
        """For each order the counts of the keys in the documents of ``trained``; begin marks count once for each document, as contexts."""
        use = np.repeat(trained, self.sizes)
        counts = []
        for keys, places, mark in zip(self.keys, self.places, self.marks):
            c = np.bincount(places[use], minlength=len(keys))
            c[mark] += int(trained.sum())
            counts.append(c)
        return counts


class Automaton:
    """The weighted automaton that a block's texts can reach.

    State 0 is the empty context, the others are the contexts that training
    has, up to ``order - 1`` words.  ``fail`` leads to the state of the context
    without its first word, for the weight ``fail_weight`` (log10).  Arcs are
    sorted by state and word, with their log10 probability and the state they
    lead to; state 0 has one for every word.
    """

    def __init__(self, block: BlockGrams, totals: list[np.ndarray], train_tokens: int, train_types: int, prior: tuple[float, float]):
        order, words = block.order, block.places[0]
        n = len(words)
        self.words, self.n_words = words, block.distinct[0]
        # The states: of each order but the last the keys that training has, and the begin marks.
        state_of, contexts, self.n_states = [], [], 1
        for k in range(1, order):
            known = totals[k - 1] > 0
            known[block.marks[k - 1]] = True
            ids = np.where(known, np.cumsum(known) - 1 + self.n_states, 0).astype(np.int32)
            state_of.append(ids)
            self.n_states += int(known.sum())
            contexts.append(totals[k - 1][known])
        c = np.concatenate([[0], *contexts]).astype(float)
        m = prior[0] * np.maximum(c, 1.0) ** prior[1]
        per_count = 1 / (c + m)
        weight = m * per_count
        del c, m, contexts
        self.fail_weight = np.log10(weight)
        self.fail = np.zeros(self.n_states, np.int32)
        for k in range(2, order):
            # A context occurs wherever a longer one that ends with it does, so it is a state too.
            self.fail[state_of[k - 1][block.places[k - 1]]] = state_of[k - 2][block.places[k - 2]]
            self.fail[state_of[k - 1][block.marks[k - 1]]] = state_of[k - 2][block.marks[k - 2]]
        self.fail[0] = 0
        self.begin = int(state_of[-1][block.marks[order - 2]]) if order > 1 else 0
        # Arcs of state 0, then those of each longer context; p: the probability of the n-gram that ends at each token.
        mass = train_tokens + 0.5 * (train_types + 1)
        self.base = np.log10((totals[0] + 0.5) / mass)
        p = ((totals[0] + 0.5) / mass)[words]
        self.root_next = state_of[0].copy() if order > 1 else np.zeros(self.n_words, np.int32)
        if order > 1:
            self.root_next[totals[0] == 0] = 0
        self.arcs, self.arc_weight, self.arc_next = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)
        bits = (self.n_states * self.n_words).bit_length()
        for k in range(2, order + 1):
            before = np.empty(n, np.int32)  # the state of the context of k - 1 words before each token
            before[1:] = state_of[k - 2][block.places[k - 2][:-1]]
            before[block.starts] = state_of[k - 2][block.marks[k - 2]]
            p *= weight[before]
            count = totals[k - 1][block.places[k - 1]]
            seen = np.flatnonzero(count > 0).astype(np.int32)
            p[seen] += count[seen] * per_count[before[seen]]
            del count
            # One token for each distinct n-gram that training has.
            of = np.full(block.distinct[k - 1], -1, np.int32)
            of[block.places[k - 1][seen]] = seen
            of = of[of >= 0]
            del seen
            arcs = before[of].astype(np.int64) * self.n_words + words[of]
            by = sorting(arcs, bits)
            of = of[by]
            last = min(k, order - 1)
            # States are numbered by order, so arcs of longer contexts come after all others.
            self.arcs = np.concatenate([self.arcs, arcs[by]])
            self.arc_weight = np.concatenate([self.arc_weight, np.log10(p[of])])
            self.arc_next = np.concatenate([self.arc_next, state_of[last - 1][block.places[last - 1][of]]])
        self.block = block

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of each word after its state, the next state): along failure arcs until there is an arc for the word."""
        total, after, state = np.zeros(len(state)), np.empty(len(state), np.int32), state.copy()
        open_ = np.arange(len(state))
        while len(open_):
            s, w = state[open_], word[open_]
            root = s == 0
            at = open_[root]
            total[at] += self.base[w[root]]
            after[at] = self.root_next[w[root]]
            open_, s, w = open_[~root], s[~root], w[~root]
            key = s.astype(np.int64) * self.n_words + w
            by = np.argsort(key)  # keys in order are found near each other
            arc = np.empty(len(key), np.int64)
            arc[by] = np.searchsorted(self.arcs, key[by])
            found = arc < len(self.arcs)
            found[found] = self.arcs[arc[found]] == key[found]
            at = open_[found]
            total[at] += self.arc_weight[arc[found]]
            after[at] = self.arc_next[arc[found]]
            open_, s = open_[~found], s[~found]
            total[open_] += self.fail_weight[s]
            state[open_] = self.fail[s]
        return total, after

    def traverse(self, lane: int = LANE) -> np.ndarray:
        """log10 probability of every token: one walk from left to right that carries the state.

        All texts take their steps abreast.  A text of more than ``lane`` tokens
        is several lanes: a state is no more than the last ``order - 1`` words, so
        a lane that begins that many words early, at the empty context, is in the
        same state where its own words begin as one that came from the text's beginning.
        """
        block, warm = self.block, self.block.order - 1
        lane = max(lane, warm + 1)
        pieces = -(-block.sizes // lane)
        text = np.repeat(np.arange(len(pieces)), pieces)
        piece = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = block.starts[text] + piece * lane
        stop = np.minimum(first + lane, block.starts[text] + block.sizes[text])
        state = np.where(piece == 0, self.begin, 0).astype(np.int32)
        for back in range(warm, 0, -1):
            later = np.flatnonzero(piece > 0)
            _, state[later] = self.step(state[later], self.words[first[later] - back])
        out = np.empty(len(self.words))
        by = np.argsort(first - stop, kind="stable")  # longest lanes first: those that still walk are a prefix
        first, length, state = first[by], (stop - first)[by], state[by]
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t, "left"))
            out[first[:n] + t], state[:n] = self.step(state[:n], self.words[first[:n] + t])
        return out


def _frugal() -> None:
    """A worker that gives large arrays back as soon as they are freed, and doesn't keep them for the next stage's workers to miss."""
    import ctypes

    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such setting
        ctypes.CDLL(None).mallopt(-3, 1 << 20)
    pa.set_memory_pool(pa.system_memory_pool())


def _texts(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def _rows(grams: BlockGrams, trained: np.ndarray, block: int, shards: int) -> pd.DataFrame:
    """Requests for a block's n-grams."""
    rows = []
    for k, counts in enumerate(grams.counted(trained), 1):
        at = _shard_bounds(grams.keys[k - 1], shards, _bits(k))
        for shard in np.flatnonzero(np.diff(at)):
            part = slice(at[shard], at[shard + 1])
            rows.append((block, (k - 1) * shards + int(shard), _packed_keys(grams.keys[k - 1][part]), _packed(counts[part])))
    return pd.DataFrame(rows, columns=["block", "shard", "keys", "counts"])


def _column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table[name].chunks) if table[name].num_chunks else pa.array([], table.schema.field(name).type)


def _requests(block: int, data: bytes, order: int, shards: int) -> pd.DataFrame:
    """A block's requests: for each shard its sorted keys and what the block's training documents count for them.

    Shards of order k are numbered from (k - 1) * ``shards`` on.  Those that the
    block has nothing for are not asked: blocks times shards would grow with the
    square of the corpus.
    """
    docs = _texts(data)
    return _rows(BlockGrams(_column(docs, "text"), order), ~docs["held_out"].to_numpy(), block, shards)


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's answers: the corpus's counts of each block's keys, in the block's order."""
    keys = [_unpacked_keys(k) for k in pdf["keys"]]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    counts = np.concatenate([_unpacked(c) for c in pdf["counts"]])[order]
    new = np.ones(len(every), bool)
    new[1:] = every[order][1:] != every[order][:-1]
    first = np.flatnonzero(new)
    total = np.add.reduceat(counts, first) if len(first) else counts
    back = np.empty(len(every), np.int64)
    back[order] = total[np.cumsum(new) - 1]
    at = np.cumsum([0, *map(len, keys)])
    return pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "totals": [_packed(back[a:b]) for a, b in zip(at, at[1:])]})


def _scores(data: bytes, answers: pd.DataFrame, order: int, shards: int, prior: tuple[float, float], train_tokens: int, train_types: int) -> pd.DataFrame:
    """A block's texts through its part of the automaton."""
    docs = _texts(data)
    block = BlockGrams(_column(docs, "text"), order, keys_too=False)
    docs = docs.select(["doc_id", "held_out"])
    answers = answers.sort_values("shard")
    of = answers["shard"].to_numpy() // shards
    totals = [np.concatenate([_unpacked(t) for t in answers["totals"][of == k]]) for k in range(order)]
    if [len(t) for t in totals] != block.distinct:
        raise RuntimeError("a block was packed anew from other rows: score a stored table")
    known = (totals[0] > 0)[block.places[0]].astype(np.int64)
    automaton = Automaton(block, totals, train_tokens, train_types, prior)
    del totals
    score = automaton.traverse()
    words = block.places[0]
    return pd.DataFrame(
        {
            "doc_id": docs["doc_id"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get),
            "held_out": docs["held_out"].to_numpy(),
            "n_tokens": block.sizes,
            "n_known": np.add.reduceat(known, block.starts),
            "train_tokens": np.full(len(docs), train_tokens, np.int64),
            "base_score": np.add.reduceat(automaton.base[words], block.starts),
            "score": np.add.reduceat(score, block.starts),
        }
    )


def _prepared(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
    )


def _chunks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.Table]:
    """Rows as they lie, so many that their texts reach ``block_bytes``, from one task."""
    held, size = [], 0
    for batch in batches:
        length = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            done = int(length[at - 1]) if at else 0
            upto = min(int(np.searchsorted(length, done + block_bytes - size)) + 1, len(batch))
            held.append(batch.slice(at, upto - at))
            size += int(length[upto - 1]) - done
            at = upto
            if size >= block_bytes:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _packed_blocks(df: DataFrame, block_bytes: int) -> DataFrame:
    """(block, data): rows of df in blocks, compressed.

    Equal rows are spread as they are in df.  A block is named by its partition and number.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _frugal()
        name = TaskContext.get().partitionId() << 32
        for n, table in enumerate(_chunks(batches, block_bytes)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_pydict({"block": pa.array([name | n], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return _prepared(df).mapInArrow(pack, "block long, data binary")


def _word_requests(df: DataFrame, block_bytes: int, shards: int) -> DataFrame:
    """(shard, keys, counts) of the training rows' words, from the rows as they lie."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _frugal()
        for table in _chunks(batches, block_bytes):
            found = _rows(BlockGrams(_column(table, "text"), 1), np.ones(len(table), bool), 0, shards)
            yield pa.RecordBatch.from_pandas(found[["shard", "keys", "counts"]], preserve_index=False)

    return _prepared(df).where("NOT held_out").mapInArrow(words, "shard long, keys binary, counts binary")


def _shard_facts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Tokens and distinct words of a shard of the words."""
    keys = np.concatenate([_unpacked_keys(k) for k in pdf["keys"]])
    counts = np.concatenate([_unpacked(c) for c in pdf["counts"]])
    real = (counts > 0) & (keys != BEGIN)
    return pd.DataFrame({"tokens": [int(counts[real].sum())], "types": [len(np.unique(keys[real]))]})


def score_documents(df: DataFrame, order: int = ORDER, prior: tuple[float, float] = PRIOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model learns from all rows outside the held-out fold.  Null and empty
    texts are one end token.  Rows that repeat count and come back as often; a
    null id counts as the empty text in the fold's checksum.  Without training
    rows every token has the mass of an unknown one.  df is read twice, and is
    to give the same rows in the same partitions, as a stored table does; if a
    lost block comes back with other rows, the job fails and scores nothing wrong.
    """
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A token is six bytes or so, and each order has at most one n-gram for it.
    shards = max(1, -(-size // (6 * SHARD_GRAMS)))
    # Tokens and types of the training rows: words alone, from the rows as they lie.
    words = _word_requests(df, 2 * block_bytes, shards).repartition(min(MOST_TASKS, shards), "shard")
    facts = words.groupBy("shard").applyInPandas(_shard_facts, "tokens long, types long").agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = facts[0] or 0, facts[1] or 0
    # As many tasks as there are blocks and shards: none reads more as the corpus grows.
    blocks = _packed_blocks(df, block_bytes).repartition(min(MOST_TASKS, -(-size // block_bytes) or 1), "block")

    def requests(pdf: pd.DataFrame) -> pd.DataFrame:
        _frugal()
        return _requests(pdf["block"].iloc[0], pdf["data"].iloc[0], order, shards)

    def scored(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        _frugal()
        return _scores(docs["data"].iloc[0], found, order, shards, prior, tokens, types)

    # Both passes read the blocks from one exchange: rows move once, compressed.
    asked = blocks.groupBy("block").applyInPandas(requests, "block long, shard long, keys binary, counts binary")
    asked = asked.repartition(min(MOST_TASKS, order * shards), "shard")
    answers = asked.groupBy("shard").applyInPandas(_answers, "block long, shard long, totals binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        scored,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def digests(df: DataFrame) -> DataFrame:
    return score_documents(df)
