"""Token ids by the tokenizers library, over Arrow batches.

Texts are cut at safe boundaries, places where no token can span. The distinct pieces that
a worker has not met lately are encoded in batches by the library; a piece's ids are then
looked up. Two generations of pieces bound the memory: when the newer one is full it
becomes the older one, and pieces still in use move back.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import KEPT, bytes_of, lean, texts_in

#: A task has one core; threads of the library beside it would take time and memory of their own.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes that a generation of pieces takes, there are two of them; and the same where a worker
#: holds only ids and counts besides.
PIECES, MANY_PIECES = 20_000_000, 90_000_000
#: Bytes that an entry takes beside its piece and its ids (a guess), and of the longest piece
#: that is kept.
ENTRY, LONGEST = 160, 64
#: Bytes of text that are encoded together.
BATCH_BYTES = 4_000_000
#: A longer text is cut, at a safe boundary, into parts of at most about so many bytes.
PART_BYTES = 1_000_000


class Pieces:
    """Ids of pieces (little-endian 32-bit, as bytes; or OPEN). The pieces kept are bounded in
    bytes; long ones, as in text without spaces, are encoded whenever they are met."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes | bool]], bound: int = PIECES):
        self.encode, self.bound, self.size = encode, bound, 0
        self.new: dict[bytes, bytes | bool] = {}
        self.old: dict[bytes, bytes | bool] = {}

    def of(self, pieces: list[bytes]) -> list[bytes | bool]:
        found = list(map(self.new.get, pieces))
        gone = [k for k, v in enumerate(found) if v is None]
        if gone:
            if self.size > self.bound:
                self.old, self.new, self.size = self.new, {}, 0
            made = {pieces[k]: None for k in gone}
            old = self.old
            todo = [p for p in made if p not in old]
            if len(todo) < len(made):
                made.update((p, old[p]) for p in made if p in old)
            made.update(zip(todo, self.encode(todo)))
            for k in gone:
                found[k] = made[pieces[k]]
            if max(map(len, made)) > LONGEST:
                made = {p: v for p, v in made.items() if len(p) <= LONGEST}
            self._keep(made)
        return found

    def _keep(self, made: dict[bytes, bytes | bool]) -> None:
        self.new.update(made)
        self.size += ENTRY * len(made) + 3 * sum(map(len, made))  # ids of twice a piece's bytes


#: Stands for the ids of a piece that ends in white space, which goes on in the next piece.
OPEN = False
#: Letters of which each is one character and stays what it is in Unicode's composed form.
_LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


def _marked() -> dict[int, int]:
    """Byte-level BPE's mapping of bytes to characters: printable ones stand for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + k for k, b in enumerate(other)}


MARKED = _marked()


def _run_ids(model, run: bytes) -> bytes:
    """Ids of a run of letters, or of a mark, that is one match of the tokenizer's pattern."""
    return array("I", [t.id for t in model.tokenize(run.decode("latin-1").translate(MARKED))]).tobytes()


def _packed(ids) -> bytes:
    return array("I", ids).tobytes()


def _ascii_ids(model, run: bytes, mark: str = "") -> bytes:
    return array("I", [t.id for t in model.tokenize(mark + run.decode())]).tobytes()


class WordBpe:
    """BPE over lower-cased words, white space dropped: ids of texts by their words.

    No token spans white space there, so ASCII white space is a safe boundary. A-Z are
    lowered first, which the tokenizer does anyway, unless a text may hold a special token.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        steps = (kind.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = {x.get("type") for x in (kind.get("normalizer") or {}).get("normalizers", [])}
        if not (steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and "Lowercase" in kinds):
            raise ValueError(f"{path}: not a tokenizer of lower-cased words that drops white space")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces = Pieces(self._encode, MANY_PIECES)
        self.marks = {m: _run_ids(self.model, m) for m in (b".", b",")}

    def _encode(self, words: list[bytes]) -> list[bytes]:
        out: dict[bytes, bytes] = {}
        rest = []
        tokenize = self.model.tokenize
        for w in words:
            if w.isalpha() and w.islower():  # the shortest way for ASCII letters
                if w not in out:
                    out[w] = array("I", [t.id for t in tokenize(w.decode())]).tobytes()
                continue
            base = w[:-1]
            if w[-1:] in self.marks and base.isalpha() and base.islower():
                ids = out.get(base) or self.pieces.new.get(base) or self.pieces.old.get(base)
                if not ids:
                    ids = out[base] = _ascii_ids(self.model, base)
                out[w] = ids + self.marks[w[-1:]]
                continue
            m = _LETTERS.fullmatch(w.decode("utf-8", "replace"))
            if m:
                base = m[1].lower().encode()
                ids = out.get(base) or self.pieces.new.get(base) or self.pieces.old.get(base) or _run_ids(self.model, base)
                out[w] = ids + self.marks[m[2].encode()] if m[2] else ids
            else:
                rest.append(w)
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False) if rest else []
        out.update((w, _packed(e.ids)) for w, e in zip(rest, found))
        return [out[w] for w in words]

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        return (text if b"<|" in text else text.lower()).split()

    def ids(self, text: bytes | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces.of(self.words(text or b""))), "<u4")

    def lengths(self, texts: list[bytes | None]) -> list[int]:
        """Counts only: texts in batches of about equal bytes, long ones in parts."""
        total = [0] * len(texts)
        held: list[tuple[int, list[bytes]]] = []
        size = 0
        for row, text in enumerate(texts):
            for part in parts(text or b""):
                held.append((row, self.words(part)))
                size += len(part)
                if size >= BATCH_BYTES:
                    self._count(held, total)
                    held, size = [], 0
        self._count(held, total)
        return total

    def _count(self, held: list[tuple[int, list[bytes]]], total: list[int]) -> None:
        for row, words in held:
            total[row] += sum(map(len, self.pieces.of(words))) // 4


def parts(text: bytes, bound: int = PART_BYTES) -> Iterator[bytes]:
    """The text cut at ASCII spaces or line ends into parts of about `bound` bytes."""
    start = 0
    while len(text) - start > bound:
        cut = max(text.rfind(b" ", start, start + bound), text.rfind(b"\n", start, start + bound))
        if cut <= start:
            after = [x for x in (text.find(b" ", start + bound), text.find(b"\n", start + bound)) if x >= 0]
            if not after:
                break
            cut = min(after)
        yield text[start:cut]
        start = cut
    yield text[start:]


class ByteBpe:
    """Byte-level BPE: ids of texts, and bytes and offsets of ids.

    A token starts anew wherever white space follows another character, so each run of
    white space and the word behind it are a piece. Special tokens are plain text.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.table = byte_table(self.tokenizer)
        self.marks = {m: _run_ids(self.model, m) for m in (b".", b",")}
        self.sizes = np.array([len(b) for b in self.table], np.int64)
        self.first = Pieces(lambda ps: self._encode(ps, b""), PIECES // 8)
        self.later = Pieces(lambda ps: self._encode(ps, b" "))

    def _encode(self, pieces: list[bytes], lead: bytes) -> list[bytes | bool]:
        out: dict[bytes, bytes | bool] = {}
        rest = []
        mark = chr(MARKED[0x20]) if lead else ""
        for p in pieces:
            if p.isalpha():
                if p not in out:
                    out[p] = _ascii_ids(self.model, p, mark)
                continue
            base = p[:-1]
            if p[-1:] in self.marks and base.isalpha():
                kept = self.later if lead else self.first
                ids = out.get(base) or kept.new.get(base) or kept.old.get(base)
                if not ids:
                    ids = out[base] = _ascii_ids(self.model, base, mark)
                out[p] = ids + self.marks[p[-1:]]
                continue
            text = p.decode("utf-8", "replace")
            m = _LETTERS.fullmatch(text)
            if m:  # with the space before it one match, and the mark another
                ids = _run_ids(self.model, lead + m[1].encode())
                out[p] = ids + self.marks[m[2].encode()] if m[2] else ids
            elif lead and (not text or text[-1].isspace()):
                out[p] = OPEN
            else:
                rest.append(p)
        whole = [(p if p.startswith(b"\n") else lead + p).decode("utf-8", "replace") for p in rest]
        found = self.tokenizer.encode_batch_fast(whole, add_special_tokens=False) if rest else []
        out.update((p, _packed(e.ids)) for p, e in zip(rest, found))
        return [out[p] for p in pieces]

    def ids(self, text: bytes | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        head, *tail = text.replace(b"\n", b" \n").split(b" ")
        if not head or head.decode("utf-8", "replace")[-1].isspace():
            return self._slowly(text)
        start = self.first.of([head])[0]
        if not tail:
            return np.frombuffer(start, "<u4")
        found = self.later.of(tail)
        if OPEN in found:
            return self._slowly(text)
        return np.frombuffer(start + b"".join(found), "<u4")

    def _slowly(self, text: bytes) -> np.ndarray:
        """Pieces joined until one ends in a character that is no white space."""
        out, held = [], []
        for k, p in enumerate(text.replace(b"\n", b" \n").split(b" ")):
            held.append(p if not k or p.startswith(b"\n") else b" " + p)
            if p and not p.decode("utf-8", "replace")[-1].isspace():
                out.append(b"".join(held))
                held = []
        if held:
            out.append(b"".join(held))
        chunks = [c.decode("utf-8", "replace") for c in out if c]
        ids: list[int] = []
        for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False):
            ids += e.ids
        return np.array(ids, "<u4")

    def decode(self, ids) -> bytes:
        """The bytes of ids; a character may be split between tokens, so bytes are joined first."""
        table = self.table
        return b"".join([table[i] for i in ids])

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character spans of the tokens: a token that holds part of a character covers it."""
        data = np.frombuffer(self.decode(ids), np.uint8)
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
        return character[starts] if len(ids) else ends, character[ends - 1] + 1 if len(ids) else ends


def same_ranks(path: str, ranks: str) -> None:
    """An error unless the tokenizer at path has the very bytes and ids of a file of ranks."""
    with open(ranks, "rb") as f:
        want = {int(i): base64.b64decode(b) for b, i in map(bytes.split, f)}
    table = byte_table(Tokenizer.from_file(path))
    if any(i >= len(table) or table[i] != b for i, b in want.items()):
        raise ValueError(f"{path}: not the ranks of {ranks}")


def byte_table(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each id, by reversing the byte-to-character mapping of byte-level BPE."""
    back = {chr(c): b for b, c in MARKED.items()}
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def loaded(kind: type, path: str):
    """One encoder a worker process and file, so that what it has met serves later tasks."""
    if (kind, path) not in KEPT:
        KEPT[kind, path] = kind(path)
    return KEPT[kind, path]


def encode_bytes_bpe(docs: DataFrame, path: str, text_col: str = "text", offsets: bool = False, decode: bool = False) -> DataFrame:
    """docs with ids (array<int>) in place of text_col, and if asked starts and ends
    (characters), and decoded, the bytes that the ids decode to in the same worker.

    Null texts count as empty and give no ids. Texts are encoded whole. Repeated rows give
    a row each, an empty table none. Columns named like the results are replaced.
    """
    made = ["ids"] + ["starts", "ends"] * offsets + ["decoded"] * decode
    keep = [c for c in docs.columns if c != text_col and c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ByteBpe, path)
        for batch in batches:
            for lo, hi in runs_of(batch.column(0), BATCH_BYTES):
                ids = [bpe.ids(t) for t in texts_in(batch.column(0).slice(lo, hi - lo))]
                columns = [_lists(ids)]
                if offsets:
                    spans = [bpe.offsets(x) for x in ids]
                    columns += [_lists([s for s, _ in spans]), _lists([e for _, e in spans])]
                if decode:
                    columns.append(pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary()))
                rest = [c.slice(lo, hi - lo) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays(rest + columns, [*keep, *made])

    schema = docs.select(*keep).schema
    for name in made:
        schema = schema.add(name, T.BinaryType() if name == "decoded" else T.ArrayType(T.IntegerType()))
    return docs.select(F.col(text_col), *keep).mapInArrow(lean(run, True), schema)


def decode_bytes_bpe(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """rows with decoded (binary), the bytes of their ids. Null ids decode to no bytes; an
    id outside the vocabulary is an error. Columns named like the result are replaced."""
    keep = [c for c in rows.columns if c != "decoded"]
    at = keep.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ByteBpe, path)
        for batch in batches:
            lists = batch.column(at)
            flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            empty = np.asarray(lists.is_null())
            out = [b"" if empty[k] else bpe.decode(flat[bounds[k] : bounds[k + 1]].tolist()) for k in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*keep, "decoded"])

    return rows.select(*keep).mapInArrow(lean(run, True), rows.select(*keep).schema.add("decoded", "binary"))


def token_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit in place of text_col.

    Null texts count as empty. Special strings in a text are special tokens, the library's
    default. Repeated rows give a row each, an empty table none. Columns named like the
    results are replaced.
    """
    made = ["n_bytes", "n_tokens"]
    keep = [c for c in docs.columns if c not in (text_col, *made, "over_limit")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(WordBpe, path)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts = bytes_of(part.column(0))
                counts = [pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(bpe.lengths(texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *counts], [*keep, *made])

    schema = docs.select(*keep).schema
    for name in made:
        schema = schema.add(name, "long")
    out = docs.select(F.col(text_col), *keep).mapInArrow(lean(run, True), schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def runs_of(texts: pa.Array, bound: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about equal bytes."""
    lo = size = 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= bound:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    bounds = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=bounds[1:])
    flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
