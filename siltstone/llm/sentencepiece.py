"""SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are cut into units at places that no piece spans: before a space that
follows another character, and between characters that no piece holds side by
side.  So a unit's best path is the text's best path there.  The distinct units
of a step are grouped by length; equal-length units advance together, position by
position: hashes of their substrings probe the sorted keys of the pieces, and the
vectorised maximum over piece lengths stores its backpointer.

In a unigram model a step adds the piece's score; the path of greatest total is
taken, and among equals the one with the longest last piece.  In a BPE model a
piece may follow a piece only if merging the two texts together gives just these
two, and a step is worth 0 or minus infinity accordingly: every prefix then has one
path, the one that merging in order of rank finds, so ids equal the library's.
Characters without a piece become their UTF-8 byte pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.wordhash import U64, mix, ranges, span_hashes, steps, utf8

SPACE, BLANK = 0x2581, 0x20
#: Stands for a literal U+2581, which no piece may take for a space.
_LITERAL = 0x110000
#: Units whose paths a task remembers.
MEMORY = 400_000
STEP = 1 << 19


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model file; a few hundred kB, sent with the tasks."""

    keys: np.ndarray  # sorted substring hashes of the ordinary pieces
    ids: np.ndarray  # their ids
    scores: np.ndarray
    longest: int
    pairs: np.ndarray  # sorted hashes of neighbouring characters in pieces
    byte_ids: np.ndarray  # 256 ids, or -1
    unknown: int
    raw: np.ndarray  # bytes of all pieces, a space for SPACE
    bounds: np.ndarray
    merges: "Merges | None" = None  # of a BPE model

    @property
    def worst(self) -> float:
        return float(self.scores.min()) - 10.0 if len(self.scores) else -10.0


class Merges:
    """The merge order of a BPE model: which two pieces may stand side by side."""

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool]):
        size = len(pieces)
        ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        made = sorted((i for i in ids.values() if len(pieces[i]) > 1), key=lambda i: (-scores[i], i))
        #: place in the merge order; -1 for a single character
        self.rank = np.full(size + 1, -1, dtype=np.int64)
        self.rank[made] = np.arange(len(made))
        splits = [(len(pieces[i]), i, ids[pieces[i][:k]], ids[pieces[i][k:]]) for i in made for k in range(1, len(pieces[i])) if pieces[i][:k] in ids and pieces[i][k:] in ids]
        table = np.array(sorted(splits), dtype=np.int64).reshape(-1, 4)
        self.size = size + 1
        key = table[:, 2] * self.size + table[:, 3]
        order = np.argsort(key)
        self.keys, self.ranks = key[order], self.rank[table[order, 1]]
        #: the two pieces that a piece's last merge joins
        self.left, self.right = np.full(size + 1, -1, dtype=np.int64), np.full(size + 1, -1, dtype=np.int64)
        #: pieces that merging their own text gives back
        self.whole = self.rank < 0
        for length in np.unique(table[:, 0]):
            _, piece, a, b = table[table[:, 0] == length].T
            ok = self.whole[a] & self.whole[b]
            ok[ok] = self.apart(a[ok], b[ok], self.rank[piece[ok]])
            self.left[piece[ok]], self.right[piece[ok]] = a[ok], b[ok]
            self.whole[piece[ok]] = True

    def apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge of rank under ``limit`` joins text of a with text of b.

        Undoes the merges of a and b from the last to the first: two neighbours at
        the border that would have been merged before one of them was used up are
        against it; of equal ranks, the merge further left goes first.
        """
        out = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit.copy()
        while len(at) and len(self.keys):
            key = a * self.size + b
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            broken = (self.keys[spot] == key) & (self.ranks[spot] < limit)
            out[at[broken]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~broken & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * (1 << 21) + b


def _grown(hashes: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The hashes of substrings that each gain a character on the right."""
    return mix(hashes * U64(0x9E3779B97F4A7C15) + chars.astype(U64) + U64(1))


def vocabulary(pieces: list[tuple[str, float, str]], bpe: bool = False) -> Vocabulary:
    """From (piece, score, kind) in order of id; kind: normal, byte, control, unknown or unused."""
    normal = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind == "normal" and p]
    flat = np.concatenate([_code_points(p) for _, p, _ in normal]) if normal else np.zeros(0, np.int64)
    size = np.array([len(p) for _, p, _ in normal], dtype=np.int64)
    end = np.cumsum(size)
    keys = np.zeros(len(size), U64)
    for k in range(int(size.max(initial=0))):
        more = np.flatnonzero(size > k)
        keys[more] = _grown(keys[more], flat[(end - size)[more] + k])
    order = np.argsort(keys)
    inside = np.ones(max(0, len(flat) - 1), dtype=bool)
    inside[end[:-1] - 1] = False
    byte_ids = np.full(256, -1, dtype=np.int32)
    raw = []
    for i, (p, _, kind) in enumerate(pieces):
        if kind == "byte":
            byte_ids[int(p[1:-1], 16)] = i
        raw.append(bytes([int(p[1:-1], 16)]) if kind == "byte" else p.replace(chr(SPACE), " ").encode() if kind == "normal" else b"" if kind == "control" else " ⁇ ".encode())
    return Vocabulary(
        keys[order],
        np.array([i for i, _, _ in normal], dtype=np.int32)[order],
        np.array([s for _, _, s in normal], dtype=np.float64)[order],
        int(size.max()) if len(size) else 1,
        np.unique(_pair_keys(flat[:-1], flat[1:])[inside]) if len(flat) > 1 else np.zeros(0, np.int64),
        byte_ids,
        next((i for i, x in enumerate(pieces) if x[2] == "unknown"), 0),
        np.frombuffer(b"".join(raw), np.uint8),
        np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64),
        Merges([p for p, _, _ in pieces], [x for _, x, _ in pieces], [k == "normal" for _, _, k in pieces]) if bpe else None,
    )


def check(model) -> None:
    """Refuse a model whose settings encoding doesn't follow: it puts a space before texts and changes no character of them."""
    n, t = model.normalizer_spec, model.trainer_spec
    wrong = {
        "a normaliser of characters": n.name not in ("identity", "") or len(n.precompiled_charsmap) > 0,
        "no space before a text": not n.add_dummy_prefix,
        "removal of extra blanks": n.remove_extra_whitespaces,
        "blanks that aren't escaped": not n.escape_whitespaces,
        "blanks as suffixes": t.treat_whitespace_as_suffix,
        "a model that is neither unigram nor BPE": t.model_type not in (1, 2),
        "user-defined pieces": any(p.type == 4 for p in model.pieces),
    }
    found = [name for name, is_so in wrong.items() if is_so]
    if found:
        raise ValueError(f"this model has {', '.join(found)}")


def load(model_file: str) -> Vocabulary:
    """Read a SentencePiece model, unigram or BPE, on the driver; models with other settings are refused."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(model_file, "rb") as f:
        model.ParseFromString(f.read())
    check(model)
    kinds = {1: "normal", 2: "unknown", 3: "control", 5: "unused", 6: "byte"}
    return vocabulary([(p.piece, p.score, kinds[p.type]) for p in model.pieces], bpe=model.trainer_spec.model_type == 2)


def _best_paths(chars: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(n, L) code points of equal-length units to flat ids and their count a unit; -1 for a character without a piece."""
    n, length = chars.shape
    own = np.zeros((n, length), dtype=U64)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0.0
    back = np.zeros((n, length + 1), dtype=np.int32)
    piece = np.full((n, length + 1), -1, dtype=np.int32)
    for end in range(1, length + 1):
        widths = np.arange(min(end, v.longest), 0, -1)
        starts = end - widths
        # the substrings that begin at each start grow by the character before the end
        key = own[:, starts[0] : end] = _grown(own[:, starts[0] : end], chars[:, end - 1 : end])
        key = key.reshape(-1)
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        known = (v.keys[at] == key).reshape(n, -1)
        if v.merges is None:
            value = np.where(known, v.scores[at].reshape(n, -1), -np.inf)
            value[:, -1] = np.where(known[:, -1], value[:, -1], v.worst)
        else:
            value = np.where(known, 0.0, -np.inf)
            value[:, -1] = np.where(known[:, -1], 0.0, -1.0)
            r, c = np.nonzero(known)
            before, now = piece[r, starts[c]], v.ids[at].reshape(n, -1)[r, c].astype(np.int64)
            bad = ~v.merges.whole[now]
            check = np.flatnonzero(~bad & (before >= 0))
            bad[check] = ~v.merges.apart(before[check].astype(np.int64), now[check])
            value[r[bad], c[bad]] = -np.inf
        total = best[:, starts] + value
        pick = total.argmax(axis=1)
        row = np.arange(n)
        best[:, end] = total[row, pick]
        back[:, end] = starts[pick]
        piece[:, end] = np.where(known[row, pick], v.ids[at].reshape(n, -1)[row, pick], -1)
    where = np.full(n, length, dtype=np.int64)
    out = np.full((n, length), -2, dtype=np.int32)
    slot = length - 1
    row = np.arange(n)
    while True:
        live = where[row] > 0
        row = row[live]
        if not len(row):
            break
        out[row, slot] = piece[row, where[row]]
        where[row] = back[row, where[row]]
        slot -= 1
    used = out != -2
    return out[used], used.sum(axis=1)


class Encoder:
    """Encodes Arrow string columns; remembers the paths of units."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.seen = np.zeros(0, dtype=U64)
        self.at = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def _units(self, chars: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Where units begin."""
        cut = np.zeros(len(chars), dtype=bool)
        cut[heads] = True
        if len(chars) > 1 and len(self.v.pairs):
            key = _pair_keys(chars[:-1], chars[1:])
            at = np.minimum(np.searchsorted(self.v.pairs, key), len(self.v.pairs) - 1)
            cut[1:] |= self.v.pairs[at] != key
            cut[1:] |= (chars[1:] == SPACE) & (chars[:-1] != SPACE)
        elif len(chars) > 1:
            cut[1:] = True
        return np.flatnonzero(cut)

    def _learn(self, hashes: np.ndarray, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Find the paths of new units and merge them into memory."""
        size = end - start
        order = np.argsort(size, kind="stable")
        ids, counts = [], np.zeros(len(size), dtype=np.int64)
        edge = np.flatnonzero(np.append(True, np.diff(size[order]) > 0))
        for a, b in zip(edge, np.append(edge[1:], len(order)), strict=True):
            length = int(size[order[a]])
            wide = max(1, (1 << 16) // (length * min(length, self.v.longest)))
            for c in range(a, b, wide * 8):
                mine = order[c : min(b, c + wide * 8)]
                own = chars[start[mine][:, None] + np.arange(length)]
                flat, n = _best_paths(own, self.v)
                if (flat < 0).any():  # units without a piece are single characters
                    flat, n = self._as_bytes(flat, n, own)
                ids.append(flat)
                counts[mine] = n
        # lay the new paths out in the order of their hashes, after those already known
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        begin = np.zeros(len(size), dtype=np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        if len(self.seen) > MEMORY:
            self.seen, self.at, self.ids = self.seen[:0], np.zeros(1, np.int64), self.ids[:0]
        all_hash = np.concatenate((self.seen, hashes))
        all_begin = np.concatenate((self.at[:-1], begin + len(self.ids)))
        all_count = np.concatenate((np.diff(self.at), counts))
        pool = np.concatenate((self.ids, flat))
        order = np.argsort(all_hash, kind="stable")
        self.seen = all_hash[order]
        self.ids = pool[ranges(all_begin[order], all_count[order])]
        self.at = np.concatenate(([0], np.cumsum(all_count[order])))

    def _as_bytes(self, flat: np.ndarray, counts: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, n, at = [], counts.copy(), 0
        for r in range(len(counts)):
            place = 0
            for x in flat[at : at + counts[r]].tolist():
                if x >= 0:
                    out.append(x)
                    place += len(self.v.raw[self.v.bounds[x] : self.v.bounds[x + 1]].tobytes().decode())
                    continue
                c = int(chars[r, place])
                place += 1
                own = [int(self.v.byte_ids[b]) for b in chr(SPACE if c == _LITERAL else c).encode("utf-8", "surrogatepass")]
                own = own if min(own) >= 0 else [self.v.unknown]
                out += own
                n[r] += len(own) - 1
            at += counts[r]
        return np.array(out, dtype=np.int32), n

    def encode(self, column: pa.Array) -> pa.ListArray:
        data, bounds = utf8(column)
        parts, sizes = [], []
        for i, j in steps(bounds, STEP):
            chars = _code_points(data[bounds[i] : bounds[j]].tobytes().decode("utf-8"))
            chars = np.where(chars == SPACE, _LITERAL, np.where(chars == BLANK, SPACE, chars))
            lead = (data[bounds[i] : bounds[j]] & 0xC0) != 0x80
            at = np.concatenate(([0], np.cumsum(lead)))[bounds[i : j + 1] - bounds[i]]
            some = np.diff(at) > 0
            # every text that isn't empty gets a space before it
            chars = np.insert(chars, at[:-1][some], SPACE)
            at = at + np.concatenate(([0], np.cumsum(some)))
            heads = at[:-1][some]
            if not len(chars):
                sizes.append(np.zeros(j - i, np.int64))
                continue
            start = self._units(chars, heads)
            end = np.append(start[1:], len(chars))
            hashes = span_hashes(chars, start, end)
            distinct, index, back = np.unique(hashes, return_index=True, return_inverse=True)
            spot = np.minimum(np.searchsorted(self.seen, distinct), max(0, len(self.seen) - 1))
            new = self.seen[spot] != distinct if len(self.seen) else np.ones(len(distinct), bool)
            if new.any():
                if len(self.seen) + int(new.sum()) > MEMORY:  # begin anew with this step's units
                    self.seen, self.at, self.ids, new = self.seen[:0], np.zeros(1, np.int64), self.ids[:0], np.ones(len(distinct), bool)
                self._learn(distinct[new], chars, start[index[new]], end[index[new]])
                spot = np.searchsorted(self.seen, distinct)
            spot = spot[back]
            count = np.diff(self.at)[spot]
            parts.append(self.ids[ranges(self.at[:-1][spot], count)])
            total = np.concatenate(([0], np.cumsum(count)))
            sizes.append(np.diff(total[np.searchsorted(start, at)]))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(flat))


def decode_lists(lists: pa.ListArray, v: Vocabulary) -> list[bytes]:
    """The UTF-8 bytes of each row of ids; the space put before a text is taken off again."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    out: list[bytes] = []
    for i, j in steps(offsets, STEP // 4):
        ids = values[offsets[i] : offsets[j]]
        ids = np.where((ids < 0) | (ids >= len(v.bounds) - 1), v.unknown, ids)
        size = v.bounds[ids + 1] - v.bounds[ids]
        flat = v.raw[ranges(v.bounds[ids], size)].tobytes()
        at = np.concatenate(([0], np.cumsum(size)))[offsets[i : j + 1] - offsets[i]].tolist()
        rows = (flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
        out += [r[1:] if r[:1] == b" " else r for r in rows]
    return out


def _parts(batches, place: int):
    """Batches cut to at most 4 STEPs of text, or a row, so that a task's memory is bounded."""
    for batch in batches:
        _, bounds = utf8(batch.column(place))
        for i, j in steps(bounds, 4 * STEP):
            yield batch.slice(i, j - i)


def encode(docs: DataFrame, v: Vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with an array of piece ids; other columns stay, and a column ``ids_col`` is replaced.

    Null and empty texts have no pieces; a very long text is a step of its own and
    encoded whole.  Of paths of equal worth the one with the longest last piece is
    taken.  Repeated rows give repeated rows, an empty table an empty result.
    """
    kept = [c for c in docs.columns if c != ids_col]
    place = kept.index(text_col)
    base = docs.select(*[F.col(f"`{c}`") for c in kept])

    def task(batches):
        encoder = Encoder(v)
        for batch in _parts(batches, place):
            yield pa.RecordBatch.from_arrays([*batch.columns, encoder.encode(batch.column(place))], [*kept, ids_col])

    return base.mapInArrow(task, T.StructType([*base.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, v: Vocabulary, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; null ids give the empty text.

    Unknown and out-of-range ids give the unknown mark, control ids nothing, and
    bytes that aren't UTF-8 the replacement character.
    """
    kept = [c for c in rows.columns if c != text_col]
    place = kept.index(ids_col)
    base = rows.select(*[F.col(f"`{c}`") for c in kept])

    def task(batches):
        for batch in batches:
            lists = batch.column(place)
            lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32())) if lists.null_count or lists.offset else lists
            texts = [x.decode("utf-8", "replace") for x in decode_lists(lists, v)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, text_col])

    return base.mapInArrow(task, T.StructType([*base.schema.fields, T.StructField(text_col, T.StringType())]))


def encode_checked(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, n_pieces, ids, round_trip``: each text's ids, and whether they decode to it.

    Rows are taken as in :func:`encode`; a null text counts as empty, other columns are ignored.
    """

    def task(batches):
        encoder = Encoder(v)
        for batch in _parts(batches, 1):
            lists = encoder.encode(batch.column(1))
            data, bounds = utf8(batch.column(1))
            raw = [data[bounds[r] : bounds[r + 1]].tobytes() for r in range(batch.num_rows)]
            same = [a == b for a, b in zip(decode_lists(lists, v), raw, strict=True)]
            chars = [int(((np.frombuffer(x, np.uint8) & 0xC0) != 0x80).sum()) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64()), pa.array(np.diff(lists.offsets.to_numpy()).astype(np.int64)), lists, pa.array(same, pa.bool_())], ["doc_id", "n_chars", "n_pieces", "ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, n_chars long, n_pieces long, ids array<int>, round_trip boolean")
