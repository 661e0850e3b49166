"""Cross-tokenizer alignment by segment deduplication.

A is a byte-level BPE file of the tokenizers library, B a sentencepiece BPE model with byte
fallback; both see a blank and the text. The text is cut before every run of blanks that
follows a character which is not white space. ``Tokenizers`` verifies over both vocabularies
that no entry holds such a place, so no merge crosses a cut, and that neither tokenizer has
another normaliser or splitter; otherwise it raises an error. Distinct segments are tokenised
and aligned once each, however often they occur.

1. One narrow pass cuts the texts in chunks of bounded size and writes, for each chunk, its
   documents as lists of places in the chunk's own dictionary of segments, the commonest
   first, and that dictionary.
2. The dictionaries' segments, made distinct, are tokenised and aligned.
3. Links of distinct segments, weighted by how often each occurs, give the count of each pair
   of ids, and those the best count of each B id. Their sums over a segment's links are looked
   up in the tasks if there are at most ``LOOKED_UP`` pairs of ids, else joined.
4. Alignments join back to the dictionaries; a chunk's documents meet its dictionary in one
   group, whose size the chunk bounds, and are composed there.

What travels is one list of small numbers a document and one row for each chunk and segment;
alignments go back to the chunks in bundles. No row is made for each occurrence. The commonest segment is one row a chunk, a key that
adaptive execution splits.

Null and empty texts, and texts that B's normaliser would change or that hold U+2581 (B writes
blanks so, hence its bytes would differ), have no tokens: all numbers are 0 and ``groups`` is
empty. Special tokens' strings inside texts are plain text. Repeated rows each count. A very
long text is a chunk of its own. Extra columns are not needed and not returned.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .bpe import byte_symbols
from .common import slices

CHUNK_BYTES, SEGMENTS_BYTES, LOOKED_UP, PART, DOCS, BUNDLED = 16 << 20, 1 << 18, 1 << 22, 1 << 16, 256, 1 << 18
SEGMENT = re.compile(r" +[^ ]*(?:(?<=\s) +[^ ]*)*")
MARK = "▁"


def segments(text: str) -> list[str]:
    """Of a blank and the text; each segment starts with a blank."""
    return SEGMENT.findall(" " + text)


class Tokenizers:
    """Both vocabularies, verified, with the bytes of each token."""

    def __init__(self, path_a: str, path_b: str):
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        spec = json.loads(self.a.to_str())
        splitter = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex"):
            raise ValueError(f"{path_a}: only byte-level splitting without a normaliser is known not to cross blanks")
        back = {s: b for b, s in byte_symbols().items()}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(back[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        fallback = {p for i, p in enumerate(pieces) if self.b.is_byte(i)}
        if len(fallback) != 256 or self.b.piece_to_id(MARK) == self.b.unk_id():
            raise ValueError(f"{path_b}: needs byte fallback and a piece for the blank")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for path, tokens in ((path_a, self.bytes_a), (path_b, self.bytes_b)):
            crossing = [t for t in tokens if re.search(r"\S ", t.decode("utf-8", "replace"))]
            if crossing:
                raise ValueError(f"{path}: tokens such as {crossing[0]!r} reach over a cut")
        if not self.plain(" a  b "):
            raise ValueError(f"{path_b}: the normaliser changes blanks")
        self.len_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.len_b = np.array([len(t) for t in self.bytes_b], np.int64)

    def plain(self, text: str) -> bool:
        """Whether both tokenizers give back the bytes of a blank and the text."""
        return MARK not in text and self.b.normalize(text) == MARK + text.replace(" ", MARK)

    def align(self, found: list[str]) -> tuple[list, list, np.ndarray, np.ndarray, np.ndarray]:
        """Of segments: A's ids, B's ids, and of all common ends, in order, the segment and
        the places of the A and the B token that end there (over all ids in a row)."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(found, add_special_tokens=False)]  # without offsets
        # the model puts the first blank there itself; of nothing but that blank it makes nothing
        ids_b = [got or [self.b.piece_to_id(MARK)] for got in self.b.encode([s[1:] for s in found], num_threads=1)]
        flat_a, flat_b = (np.fromiter((i for ids in own for i in ids), np.int64) for own in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        total = np.cumsum([len(s.encode()) for s in found])
        n_a, n_b = np.array([len(i) for i in ids_a]), np.array([len(i) for i in ids_b])
        if not (np.array_equal(end_a[np.cumsum(n_a) - 1], total) and np.array_equal(end_b[np.cumsum(n_b) - 1], total)):
            raise ValueError("tokens of a segment do not give back its bytes")
        _, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        return ids_a, ids_b, np.searchsorted(np.cumsum(n_a), at_a, side="right"), at_a, at_b


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits to a byte, the lowest first, bit 7 set where more follow; where each ends."""
    numbers = numbers.astype(np.int64, copy=False)
    most = -(-int(numbers.max(initial=1)).bit_length() // 7)
    size = sum(((numbers >> 7 * k > 0).astype(np.int64) for k in range(1, most)), np.ones(len(numbers), np.int64))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(most):
        some = size > k
        out[(ends - size + k)[some]] = ((numbers[some] >> 7 * k) & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    if not len(raw):
        return raw
    start = np.flatnonzero(np.concatenate(([True], raw[:-1] < 128)))
    place = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
    return np.add.reduceat((raw & 127) << 7 * place, start)


def packed_groups(ids_a: list, ids_b: list, segment: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> list[bytes]:
    """Of each segment its groups: numbers of A and B tokens, then the ids, packed."""
    flat = [np.fromiter((i for ids in own for i in ids), np.int64) for own in (ids_a, ids_b)]
    size = [np.diff(at, prepend=-1) for at in (at_a, at_b)]
    off = np.cumsum(2 + size[0] + size[1]) - (2 + size[0] + size[1])
    out = np.zeros(int((2 + size[0] + size[1]).sum()), np.int64)
    out[off], out[off + 1] = size
    for ids, n, first in ((flat[0], size[0], off + 2), (flat[1], size[1], off + 2 + size[0])):
        out[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    data, ends = packed(out)
    last = np.searchsorted(segment, np.arange(len(ids_a)), side="right")  # groups up to each segment's end
    cuts = np.concatenate(([0], ends))[np.append(off, len(out))[last]].tolist()
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip([0, *cuts], cuts)]


def group_texts(numbers: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Of the groups between each two cuts: numbers of A tokens, B tokens and groups;
    ``a1,a2|b1;a3|b2``."""
    values, counts, out = numbers.tolist(), [], []
    words = list(map(str, values))
    for i, end in zip(cuts.tolist(), cuts[1:].tolist()):
        n_a = n_b = 0
        groups = []
        while i < end:
            first = i + 2
            middle = first + values[i]
            last = middle + values[i + 1]
            n_a, n_b = n_a + values[i], n_b + values[i + 1]
            groups.append(",".join(words[first:middle]) + "|" + ",".join(words[middle:last]))
            i = last
        counts.append((n_a, n_b, len(groups)))
        out.append(";".join(groups))
    return np.array(counts, np.int64).reshape(-1, 3).T, out


def _loaded(path_a: str, path_b: str, made=[]) -> Tokenizers:  # noqa: B006  one pair a worker
    if not made or made[0][0] != (path_a, path_b):
        made[:] = [((path_a, path_b), Tokenizers(path_a, path_b))]
    return made[0][1]


def chunks(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Written rows of two kinds: documents (``chunk, doc_id, places``, packed) and dictionary
    entries (``chunk, place, segment, n``)."""

    def run(batches):
        own, at, size, known, ids, lists = TaskContext.get().partitionId() << 32, 0, 0, {}, [], []
        for batch in slices(batches, "t", chunk_bytes):
            plain, texts = _loaded(path_a, path_b).plain, batch.column(1).to_pylist()
            held = sum(len(t or "") for t in texts)
            if ids and size + held > chunk_bytes:
                yield from written(own + at, known, ids, lists)
                at, size, known, ids, lists = at + 1, 0, {}, [], []
            size += held
            ids.append(batch.column(0))
            for t in texts:
                found = segments(t) if t and plain(t) else []
                lists.append(np.array([known.setdefault(s, len(known)) for s in found], np.int32))
        if ids:
            yield from written(own + at, known, ids, lists)

    def written(chunk, known, ids, lists):
        """The commonest segments get the smallest places."""
        n = np.zeros(len(known), np.int64)
        for found in lists:
            np.add.at(n, found, 1)
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(known), np.int32)
        place[order] = np.arange(len(known), dtype=np.int32)
        ids = pa.concat_arrays(ids)
        for i in range(0, len(lists), DOCS):
            some = lists[i : i + DOCS]
            data, ends = packed(place[np.concatenate(some)])
            cuts = np.concatenate(([0], ends))[np.cumsum([0, *map(len, some)])].tolist()
            whole, k = data.tobytes(), len(some)
            part = pa.array([whole[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * k, pa.int64()), ids.slice(i, k), part, pa.nulls(k, pa.int32()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())], names)
        words = list(known)
        for i in range(0, len(words), PART):
            some = order[i : i + PART]
            k = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(np.arange(i, i + k, dtype=np.int32)), pa.array([words[w] for w in some.tolist()], pa.string()), pa.array(n[some])], names)

    names = ["chunk", "doc_id", "places", "place", "segment", "n"]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    return materialize(rows.mapInArrow(run, "chunk long, doc_id long, places binary, place int, segment string, n long"), "zstd")


def aligned_segments(found: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Of distinct ``segment, n``, written: these, ``groups`` (packed) and ``links`` (A's id in
    the upper half)."""

    def run(batches):
        for batch in slices(batches, "segment", SEGMENTS_BYTES):
            tools, words = _loaded(path_a, path_b), batch.column(0).to_pylist()
            ids_a, ids_b, segment, at_a, at_b = tools.align(words)
            flat_a, flat_b = (np.fromiter((i for ids in own for i in ids), np.int64) for own in (ids_a, ids_b))
            cuts = np.searchsorted(segment, np.arange(len(words) + 1)).astype(np.int32)
            links = pa.ListArray.from_arrays(cuts, pa.array(flat_a[at_a] << 32 | flat_b[at_b]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed_groups(ids_a, ids_b, segment, at_a, at_b), pa.binary()), links], ["segment", "n", "groups", "links"])

    return materialize(found.select("segment", "n").mapInArrow(run, "segment string, n long, groups binary, links array<long>"), "zstd")


def link_counts(aligned: DataFrame) -> DataFrame:
    """Written ``link, count, best``: of each pair of ids how many links of the corpus hold it,
    and whether no other pair with its B id has more."""
    counts = materialize(aligned.select(F.explode("links").alias("link"), "n").groupBy("link").agg(F.sum("n").alias("count")))
    b = F.col("link").bitwiseAND(F.lit(0xFFFFFFFF))
    top = counts.groupBy(b.alias("b")).agg(F.max("count").alias("top"))
    return materialize(counts.join(top, b == F.col("b")).select("link", "count", (F.col("count") == F.col("top")).alias("best")))


def with_sums(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``segment, groups, n_best, count_sum``: the sums over each segment's links."""
    if counts.count() > LOOKED_UP:
        each = aligned.select(F.col("segment").alias("s2"), F.explode("links").alias("link")).join(counts, "link")
        sums = each.groupBy("s2").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
        return aligned.join(sums, F.col("segment") == F.col("s2")).select("segment", "groups", "n_best", "count_sum")
    rows = counts.orderBy("link").toPandas()
    shared = aligned.sparkSession.sparkContext.broadcast((rows["link"].to_numpy(np.int64), rows["count"].to_numpy(np.int64), rows["best"].to_numpy(bool)))

    def run(batches):
        link, count, best = shared.value
        for batch in batches:
            cuts = batch.column(2).offsets.to_numpy()
            at = np.searchsorted(link, batch.column(2).flatten().to_numpy())
            sums = [np.diff(np.concatenate(([0], np.cumsum(x[at], dtype=np.int64)))[cuts - cuts[0]]) for x in (best, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, sums)], ["segment", "groups", "n_best", "count_sum"])

    return aligned.select("segment", "groups", "links").mapInArrow(run, "segment string, groups binary, n_best long, count_sum long")


def _bundle(places: np.ndarray, best: np.ndarray, count: np.ndarray, groups: list[bytes]) -> bytes:
    whole = b"".join(groups)
    size = np.array([len(g) for g in groups], np.int64)
    numbers = np.add.reduceat(np.frombuffer(whole, np.uint8) < 128, np.cumsum(size) - size, dtype=np.int64)  # of each entry
    parts = [packed(x)[0].tobytes() for x in (places, best, count, numbers)] + [whole]
    return len(groups).to_bytes(4, "little") + zstandard.compress(np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts), 3)


def _unbundle(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, best, count, where each entry's numbers begin and end, all numbers."""
    raw = zstandard.decompress(data[4:])
    cuts = np.concatenate(([0], np.cumsum(np.frombuffer(raw[:20], "<u4").astype(np.int64)))) + 20
    places, best, count, n, numbers = (unpacked(raw[a:b]) for a, b in zip(cuts, cuts[1:]))
    return places, best, count, np.concatenate(([0], np.cumsum(n))), numbers


def bundled(entries: DataFrame) -> DataFrame:
    """``in_chunk, bundle``: the rows (in_chunk, place, groups, n_best, count_sum) of each chunk
    that a task holds at a time, in one."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BUNDLED:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    def flush(held):
        t = pa.Table.from_batches(held)
        chunk, place, best, count = (t.column(c).to_numpy().astype(np.int64) for c in ("in_chunk", "place", "n_best", "count_sum"))
        groups, order = t.column("groups").to_pylist(), np.lexsort((place, chunk))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(chunk[order])) + 1, [len(order)]))
        rows = [order[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([int(chunk[r[0]]) for r in rows], pa.int64()), pa.array([_bundle(place[r], best[r], count[r], [groups[i] for i in r.tolist()]) for r in rows], pa.binary())], ["in_chunk", "bundle"])

    return entries.select("in_chunk", "place", "groups", "n_best", "count_sum").mapInArrow(run, "in_chunk long, bundle binary")


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every document."""
    Tokenizers(path_a, path_b)  # a file that does not fit fails here, not in the tasks
    cut = chunks(docs, path_a, path_b, doc_id, text, chunk_bytes)
    entries = cut.where("segment is not null")
    aligned = aligned_segments(entries.groupBy("segment").agg(F.sum("n").alias("n")), path_a, path_b)
    known = with_sums(aligned, link_counts(aligned))
    entries = entries.select(F.col("chunk").alias("in_chunk"), "place", "segment").join(known, "segment").drop("segment")

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        size = sum(int.from_bytes(x.as_py()[:4], "little") for x in right.column("bundle"))
        numbers, texts = np.zeros((5, size), np.int64), [""] * size
        for x in right.column("bundle"):  # one at a time
            places, best, count, cuts, groups = _unbundle(x.as_py())
            own, words = group_texts(groups, cuts)
            numbers[:3, places], numbers[3, places], numbers[4, places] = own, best, count
            for i, w in zip(places.tolist(), words):
                texts[i] = w
        out = []
        for part in left.to_batches(max_chunksize=1024):
            rows, written = np.zeros((5, part.num_rows), np.int64), []
            for k, raw in enumerate(part.column(part.schema.get_field_index("places")).to_pylist()):
                places = unpacked(raw)
                rows[:, k] = [x[places].sum() for x in numbers]
                written.append(";".join([texts[i] for i in places.tolist()]))
            a, b, groups, best, count = map(pa.array, rows)
            # at a common end one token of A and one of B end: as many links as groups
            out.append(pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), a, b, groups, groups, best, count, pa.array(written, pa.string())], schema=result))
        return pa.Table.from_batches(out, result)

    result = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups", pa.string())])
    by_chunk = cut.where("segment is null").select("chunk", "doc_id", "places").groupBy("chunk").cogroup(bundled(entries).groupBy("in_chunk"))
    return by_chunk.applyInArrow(compose, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
