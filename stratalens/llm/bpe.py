"""BPE encoding and decoding with a public vocabulary file.

A word's symbols form a doubly linked list. A heap holds the candidate merges as
(rank, position); the least is taken, skipped if one of its two symbols has changed since
it was pushed, else merged, and the pairs with the new neighbours are pushed. Decoding
looks the ids up and concatenates the vocabulary strings.

The file (a parameter, read on the driver; 49k entries, size-checked) is broadcast. Tasks
keep the ids of the words they have met, up to ``CACHE`` words, so a frequent word is
merged once. Every text is encoded whole; nothing is shuffled.

Null and empty texts give no ids and an empty decoded text. Strings of special tokens in
a text become their ids, as the library does by default. Extra columns are not needed
and not returned; repeated rows are encoded alike. A very long text takes memory of some
forty times its size, in its task alone. A file that asks for another normalizer, splitter,
decoder or option than this module does raises an error.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import map_batches

CACHE, MAX_FILE_BYTES = 200_000, 64 << 20


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte, as byte-level vocabularies write them."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def unsupported(spec: dict) -> list[str]:
    """What a tokenizer file asks for that this module would not do as the library does."""
    kinds = lambda part, inner: [x.get("type") for x in ((part or {}).get(inner) or [part or {}])]
    out = [k for k in ("decoder", "truncation", "padding") if spec.get(k)]
    if kinds(spec.get("normalizer"), "normalizers") != ["NFC", "Replace", "Lowercase"]:
        out.append("a normalizer other than NFC, white space and lower case")
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [x.get("type") for x in pre] != ["Split", "ByteLevel"] or pre[0].get("behavior") != "Removed" or not pre[0].get("invert") or pre[1].get("use_regex") or pre[1].get("add_prefix_space"):
        out.append("a pre-tokenizer other than a split by pattern and bytes")
    model = spec.get("model") or {}
    out += [f"model {k}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    out += [f"added token {k}" for k in ("single_word", "lstrip", "rstrip", "normalized") if any(t.get(k) for t in spec.get("added_tokens", []))]
    return out


class Vocabulary:
    """What the tokenizer file says, ready for encoding and decoding."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        symbols = byte_symbols()
        self.inner = [self.ids.get(symbols[b]) for b in range(256)]
        self.final = [self.ids.get(symbols[b] + self.suffix) for b in range(256)]
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # fixed values: what the library takes as white space
        blank = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.pieces = regex.compile(split.replace(r"[^\s", f"[^{blank}"))
        self.ascii_pieces = re.compile(split.replace(r"[^\s", r"[^\t-\r ").replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))
        self.cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str) -> dict:
        with open(path, "rb") as f:
            data = f.read(MAX_FILE_BYTES + 1)
        if len(data) > MAX_FILE_BYTES:
            raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes; it would be broadcast")
        spec = json.loads(data)
        unknown = unsupported(spec)
        if unknown:
            raise ValueError(f"{path}: not supported: {', '.join(unknown)}")
        return spec

    def merge(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece: best-ranked merge first, leftmost among equals."""
        raw = piece.encode("utf-8", "surrogatepass")
        sym = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        sym = [s for s in sym if s is not None]
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        find = self.merges.get
        heap = []
        for i in range(n - 1):
            if m := find((sym[i], sym[i + 1])):
                heap.append((m[0], i, sym[i], sym[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # stale: a neighbour was merged meanwhile
            sym[i], sym[j] = new, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if m := find((new, sym[k])):
                    heapq.heappush(heap, (m[0], i, new, sym[k], m[1]))
            h = left[i]
            if h >= 0 and (m := find((sym[h], new))):
                heapq.heappush(heap, (m[0], h, sym[h], new, m[1]))
        return tuple(s for s in sym if s >= 0)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for part in self.split_special.split(text or "") if self.split_special else [text or ""]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if part.isascii():
                pieces = self.ascii_pieces.findall(part.lower())
            else:
                # letter by letter: no final form of sigma
                pieces = self.pieces.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
            for p in pieces:
                got = cache.get(p)
                if got is None:
                    got = self.merge(p)
                    if len(p) <= 64:
                        if len(cache) >= CACHE:
                            cache.clear()
                        cache[p] = got
                out += got
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids; the file names no decoder, so they are
        joined by a space, unknown ids are left out."""
        strings = self.strings
        return " ".join([strings[i] for i in ids if i in strings])


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batch: pa.RecordBatch, made=[]) -> pa.RecordBatch:  # noqa: B006  one vocabulary a task
        if not made:
            made.append(Vocabulary(shared.value))
        ids = [made[0].encode(t) for t in batch.column(1).to_pylist()]
        decoded = [made[0].decode(i) for i in ids]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")), run, "doc_id long, ids array<int>, decoded string", "t")


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with the column ``decoded``; null ids give an empty text. A column of that
    name raises an error."""
    if "decoded" in {c.lower() for c in tokens.columns}:
        raise ValueError("rename the column decoded first")
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    out = tokens.withColumn("decoded", F.lit("").cast("string"))
    at = out.columns.index(ids)

    def run(batches, made=[]):  # noqa: B006
        for batch in batches:
            if not made:
                made.append(Vocabulary(shared.value))
            cols = list(batch.columns)
            cols[-1] = pa.array([made[0].decode(i or []) for i in cols[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return out.mapInArrow(run, out.schema)
