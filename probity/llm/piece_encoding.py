"""Encoding and decoding with a SentencePiece model of kind BPE with byte fallback.

Blanks are written as U+2581, one of which begins every text that isn't empty. A
text is cut wherever no piece holds the two characters next to each other: no
merge ever crosses such a place, so the parts between cuts are encoded on their
own and each distinct one once. New parts of a batch lie in flat numpy arrays of
symbols and are merged in rounds: the smallest pair rank of each part is found
(a segmented minimum), its pairs are merged from the left in all parts at once,
and parts without a pair leave. Where a merged piece could make a pair that goes
before the rest of its own rank, only the leftmost pair of the part is merged in
that round, so the order is that of one merge at a time. Characters that are no
piece become the pieces of their UTF-8 bytes.

Edge cases. Null text counts as empty: no ids, and null or empty ids decode to the
empty text. U+2581 in a text is taken for a blank, as the model's library does. Byte
pieces that form no UTF-8 decode to U+FFFD, one for each byte. Repeated rows are rows
of their own; an empty table gives no row; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

BLANK = "▁"
#: Characters, or ids, that are worked on at a time.
SLICE = 1 << 20
#: Distinct parts and their ids that a worker process keeps; it begins anew beyond either.
CACHE_PARTS, CACHE_IDS = 200_000, 2_000_000
#: Longer parts are encoded each time they come.
CACHE_LONGEST = 64
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NONE = np.iinfo(np.int64).max


class PieceModel:
    """The tables of a model file, and the parts that this worker process has met."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as protobuf

        model = protobuf.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal, trainer = model.normalizer_spec, model.trainer_spec
        plain = not normal.precompiled_charsmap and not normal.remove_extra_whitespaces and normal.escape_whitespaces and not trainer.treat_whitespace_as_suffix
        kinds = np.array([p.type for p in model.pieces])
        if trainer.model_type != protobuf.TrainerSpec.BPE or not trainer.byte_fallback or not plain or not np.isin(kinds, (NORMAL, UNKNOWN, CONTROL, BYTE)).all():
            raise ValueError("only BPE models with byte fallback, identity normalisation and no pieces of the user's are known")
        self.prefix = BLANK if normal.add_dummy_prefix else ""
        self._merges([p.piece for p in model.pieces], np.array([p.score for p in model.pieces]), kinds == NORMAL)
        self._surfaces([p.piece for p in model.pieces], kinds)
        self._forget()

    def _merges(self, pieces: list[str], scores: np.ndarray, normal: np.ndarray) -> None:
        """Symbols are pieces and the single characters in them; pairs of symbols, sorted
        by (left, right), have the symbol that they merge to and its rank."""
        ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        symbols = {p: s for s, p in enumerate([*ids, *{c for p in ids for c in p if c not in ids}])}
        self.n_symbols = len(symbols)
        self.symbol_id = np.array([ids.get(p, -1) for p in symbols])
        by_score, rank = np.unique(-np.array([scores[ids[p]] if p in ids else -np.inf for p in symbols]), return_inverse=True)
        pairs = sorted((symbols[p[:k]] * self.n_symbols + symbols[p[k:]], symbols[p]) for p in ids for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.pair_key, self.pair_to = np.array(pairs, np.int64).reshape(-1, 2).T.copy()
        self.rank = rank.astype(np.int64)
        # ranks whose pairs can't be merged at once: of several pieces, or of a piece that a better one begins or ends with
        alone = np.bincount(rank, minlength=len(by_score)) > 1
        for part in (self.pair_key // self.n_symbols, self.pair_key % self.n_symbols):
            alone[rank[part[rank[self.pair_to] <= rank[part]]]] = True
        self.one_by_one = alone
        # characters by code point, and which may stand next to each other in a piece
        chars = sorted({c for p in ids for c in p})
        self.char_at = np.zeros(0x110000, np.int16)
        self.char_at[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.char_symbol = np.array([-1, *[symbols[c] for c in chars]])
        self.n_chars = len(chars) + 1
        self.together = np.zeros(self.n_chars**2, bool)
        for p in ids:
            at = self.char_at[[ord(c) for c in p]].astype(np.int64)
            self.together[at[:-1] * self.n_chars + at[1:]] = True

    def _surfaces(self, pieces: list[str], kinds: np.ndarray) -> None:
        """The bytes that each id decodes to."""
        shown = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(BLANK, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.byte_id = np.zeros(256, np.int64)
        self.byte_id[[shown[i][0] for i in np.flatnonzero(kinds == BYTE)]] = np.flatnonzero(kinds == BYTE)
        self.surface = np.frombuffer(b"".join(shown), np.uint8)
        self.surface_length = np.array([len(x) for x in shown], np.int64)
        self.surface_first = np.cumsum(self.surface_length) - self.surface_length
        self.begins_blank = np.array([k == NORMAL and p.startswith(BLANK) for p, k in zip(pieces, kinds, strict=True)])

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat, self.first, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pair_ranks(self, symbols: np.ndarray, part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs at (at, at + 1): rank, and the symbol that they merge to."""
        rank, to = np.full(len(at), NONE), np.zeros(len(at), np.int64)
        inside = np.flatnonzero(at + 1 < len(symbols))
        left, right = at[inside], at[inside] + 1
        inside = inside[(part[left] == part[right]) & (symbols[left] >= 0) & (symbols[right] >= 0)]
        key = symbols[at[inside]] * self.n_symbols + symbols[at[inside] + 1]
        place = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        found = self.pair_key[place] == key
        to[inside[found]] = self.pair_to[place[found]]
        rank[inside[found]] = self.rank[to[inside[found]]]
        return rank, to

    def merge(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after another, and how many each has."""
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").astype(np.int64)
        symbols = self.char_symbol[self.char_at[codes]]
        symbols[symbols < 0] = -1 - codes[symbols < 0]
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        rank, to = self._pair_ranks(symbols, part, np.arange(len(symbols)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.diff(part, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            own = np.repeat(least, np.diff(np.append(first, len(part))))
            if (stop := own == NONE).any():
                done.append((part[stop], symbols[stop]))
                part, symbols, rank, to, own = (x[~stop] for x in (part, symbols, rank, to, own))
            hit = np.flatnonzero(rank == own)
            if not len(hit):
                continue
            of = part[hit]
            again = np.diff(of, prepend=-1) == 0
            run = np.maximum.accumulate(np.where(~again | (np.diff(hit, prepend=-2) > 1), np.arange(len(hit)), 0))
            hit = hit[np.where(self.one_by_one[rank[hit]], ~again, (np.arange(len(hit)) - run) % 2 == 0)]
            symbols[hit] = to[hit]
            stays = np.ones(len(symbols), bool)
            stays[hit + 1] = False
            at = (np.cumsum(stays) - 1)[hit]
            part, symbols, rank, to = (x[stays] for x in (part, symbols, rank, to))
            changed = np.unique(np.concatenate((at, at[at > 0] - 1)))
            rank[changed], to[changed] = self._pair_ranks(symbols, part, changed)
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(parts), np.int64)
        part, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(part, kind="stable")
        return self._ids(part[order], symbols[order], len(parts))

    def _ids(self, part: np.ndarray, symbols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids; those that are no piece by their bytes."""
        ids = np.where(symbols >= 0, self.symbol_id[np.maximum(symbols, 0)], -1)
        if (ids < 0).any():
            names = {s: c for c, s in zip(map(chr, np.flatnonzero(self.char_at)), self.char_symbol[1:], strict=True)}
            rare, of = np.unique(symbols[ids < 0], return_inverse=True)
            spelt = [self.byte_id[list((chr(-1 - s) if s < 0 else names[s]).encode())] for s in rare]
            count = np.ones(len(ids), np.int64)
            count[ids < 0] = np.array([len(x) for x in spelt])[of]
            out = np.repeat(ids, count)
            out[out < 0] = np.concatenate([spelt[i] for i in of])
            part, ids = np.repeat(part, count), out
        return ids.astype(np.int32), np.bincount(part, minlength=n)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32), and the texts' offsets in them."""
        if len(self.rows) > CACHE_PARTS or len(self.flat) > CACHE_IDS:
            self._forget()
        texts = [self.prefix + t.replace(" ", BLANK) if t else "" for t in texts]
        whole = "".join(texts)
        upto = np.cumsum([0, *[len(t) for t in texts]])
        kind = self.char_at[np.frombuffer(whole.encode("utf-32-le"), "<u4")].astype(np.int64)
        cut = np.ones(len(kind) + 1, bool)
        cut[1:-1] = ~self.together[kind[:-1] * self.n_chars + kind[1:]]
        cut[upto] = True
        place = np.flatnonzero(cut)
        bounds = place.tolist()
        parts = [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        n_parts = np.searchsorted(place, upto)
        kept = len(self.rows), len(self.flat), len(self.first)
        new = [p for p in dict.fromkeys(parts) if p not in self.rows]
        ids, counts = self.merge(new)
        self.first = np.append(self.first, kept[1] + np.cumsum(counts) - counts)
        self.length, self.flat = np.append(self.length, counts), np.append(self.flat, ids)
        self.rows.update(zip(new, range(kept[2], kept[2] + len(new)), strict=True))
        rows = np.fromiter(map(self.rows.__getitem__, parts), np.int64, len(parts))
        for p in new:
            if len(p) > CACHE_LONGEST:
                del self.rows[p]
        lens = self.length[rows]
        ends = np.concatenate(([0], np.cumsum(lens)))
        out = self.flat[np.repeat(self.first[rows] - ends[:-1], lens) + np.arange(ends[-1])]
        return out, ends[n_parts]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids[offsets[i] : offsets[i + 1]]."""
        ids = ids.astype(np.int64)
        lens = self.surface_length[ids]
        ends = np.concatenate(([0], np.cumsum(lens)))
        whole = self.surface[np.repeat(self.surface_first[ids] - ends[:-1], lens) + np.arange(ends[-1])].tobytes()
        # of each text the first id that shows anything: the blank that encoding put there goes
        shows = np.append(np.flatnonzero(lens), len(ids))
        lead = shows[np.searchsorted(shows, offsets[:-1])]
        strip = np.append(self.begins_blank[ids], False)[lead] & (lead < offsets[1:]) if self.prefix else np.zeros(len(lead), bool)
        return [_text(whole[a:b]) for a, b in zip((ends[offsets[:-1]] + strip).tolist(), ends[offsets[1:]].tolist(), strict=True)]


def _text(data: bytes) -> str:
    """UTF-8 as text, each byte that belongs to no character as U+FFFD."""
    shown = []
    while True:
        try:
            return "".join([*shown, data.decode()])
        except UnicodeDecodeError as e:
            shown += [data[: e.start].decode(), "�"]
            data = data[e.start + 1 :]


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """This worker process's model."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about SLICE in sum; a larger row is a run of its own."""
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > SLICE:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _with(rows: DataFrame, name: str, kind: ArrayType | StringType) -> tuple[DataFrame, StructType]:
    """rows without a column called name, and their schema with one of kind."""
    rows = rows.drop(name)
    return rows, StructType(list(rows.schema)).add(name, kind)


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of the whole text in place of the text."""
    kept, schema = _with(docs.drop(text), ids, ArrayType(IntegerType(), False))
    source = docs.select(*kept.columns, F.coalesce(F.col(text), F.lit("")).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in _slices(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                flat, offsets = own.encode(texts[a:b].to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*[c[a:b] for c in batch.columns[:-1]], lists], names=schema.names)

    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text that their ids decode to."""
    kept, schema = _with(rows, text, StringType())
    place = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_path)
        for batch in batches:
            lists = batch.column(place)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for a, b in _slices(sizes):
                offsets = np.concatenate(([0], np.cumsum(sizes[a:b], dtype=np.int64)))
                texts = own.decode(lists[a:b].flatten().to_numpy(zero_copy_only=False), offsets)
                yield pa.RecordBatch.from_arrays([*[c[a:b] for c in batch.columns], pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)


def digest(rows: DataFrame) -> DataFrame:
    """Per row (doc_id, ids, text): doc_id, n_tokens, ids_sha256, decoded_sha256."""
    written = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
