"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut where no piece can reach across, and each distinct segment of a slice is encoded once.
All its symbols lie in one flat array. A round finds the least pair rank of every segment by one
segmented minimum, merges its leftmost places in all segments at once, and compacts the array, until
no segment has a pair left. Where a merge could give birth to a pair that goes first, a segment merges
one place a round; elsewhere all its places that do not overlap, from the left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from askloom.llm import words as W

_SPACE = 0x2581
_NONE = np.iinfo(np.int32).max
_LONG = 24  # segments above this are cut further, between characters that no piece holds side by side
_loaded: dict[str, "Codec"] = {}


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all runs (begin, size), one run after the other."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(begin - (np.cumsum(size) - size), size)


class Codec:
    """Tables of one model file, and the two directions on whole arrays of texts."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {pieces[i]: i for i in plain}
        self.first_byte = sp.piece_to_id("<0x00>")
        scores = np.array([sp.get_score(i) for i in range(n)])
        # Rank by score; equal scores share a rank, and then the leftmost pair goes first.
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.single = np.full(0x110000, -1, np.int32)
        for i in plain:
            if len(pieces[i]) == 1:
                self.single[ord(pieces[i])] = i
        pairs, grown, side_by_side = {}, {}, set()
        for i in plain:
            piece = pieces[i]
            side_by_side.update((ord(a) << 21) | ord(b) for a, b in zip(piece, piece[1:]))
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * n + right] = i
                    for part in (left, right):
                        grown[part] = min(grown.get(part, _NONE), int(self.rank[i]))
        self.n = n
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pair.tolist()], np.int32)
        self.side_by_side = np.array(sorted(side_by_side), np.int64)
        # All places of a pair may merge in one round if no pair that holds the result goes before it.
        self.safe = np.array([grown.get(i, _NONE) > self.rank[i] for i in range(n)])
        spaces = {p for p in ids if chr(_SPACE) in p}
        if any(chr(_SPACE) in p.lstrip(chr(_SPACE)) for p in spaces):
            raise ValueError("the model has pieces that reach across a space")
        surface = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                surface[i] = bytes([i - self.first_byte])
            elif not sp.is_control(i):
                surface[i] = pieces[i].replace(chr(_SPACE), " ").encode() if i != self.unknown else b" \xe2\x81\x87 "
        self.surface_size = np.array([len(x) for x in surface], np.int64)
        self.surface_begin = np.cumsum(self.surface_size) - self.surface_size
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged id and rank of each pair of symbols; no rank if it is no piece."""
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        merged = np.where(self.pair[at] == key, self.merged[at], -1)
        return merged, np.where(merged >= 0, self.rank[merged], _NONE)

    def _merge(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All symbols, grouped by ``owner`` in order, after all merges."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.arange(len(symbol))
        merged = np.full(len(symbol), -1, np.int32)
        rank = np.full(len(symbol), _NONE, np.int32)
        near = np.flatnonzero(owner[1:] == owner[:-1])
        near = near[(symbol[near] >= 0) & (symbol[near + 1] >= 0)]
        merged[near], rank[near] = self._pairs(symbol[near], symbol[near + 1])
        while len(symbol):
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[begin, len(owner)])
            least = np.repeat(np.minimum.reduceat(rank, begin), size)
            live = least != _NONE
            if not live.all():
                done.append((order[~live], symbol[~live], owner[~live]))
                symbol, owner, order, merged, rank, least = (x[live] for x in (symbol, owner, order, merged, rank, least))
                if not len(symbol):
                    break
            hit = rank == least
            place = np.flatnonzero(hit)
            begins = np.r_[True, owner[place][1:] != owner[place][:-1]]
            run = np.r_[True, (np.diff(place) != 1) | begins[1:]]
            odd = (np.arange(len(place)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 1
            # Equal ranks may belong to different pieces: only safe ones of one piece merge together.
            first = merged[place][np.flatnonzero(begins)][np.cumsum(begins) - 1]
            alone = ~(self.safe[merged[place]] & (merged[place] == first))
            segment = np.cumsum(begins) - 1
            alone = np.bitwise_or.reduceat(alone, np.flatnonzero(begins))[segment]
            place = place[np.where(alone, begins, ~odd)]
            symbol[place] = merged[place]
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            at = np.cumsum(keep) - 1
            symbol, owner, order, merged, rank = (x[keep] for x in (symbol, owner, order, merged, rank))
            fresh = at[place]
            fresh = np.union1d(fresh, fresh[fresh > 0] - 1)
            merged[fresh], rank[fresh] = -1, _NONE
            fresh = fresh[fresh + 1 < len(symbol)]
            fresh = fresh[(owner[fresh] == owner[fresh + 1]) & (symbol[fresh] >= 0) & (symbol[fresh + 1] >= 0)]
            merged[fresh], rank[fresh] = self._pairs(symbol[fresh], symbol[fresh + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        order, symbol, owner = (np.concatenate(x) for x in zip(*done))
        back = np.argsort(order, kind="stable")
        return symbol[back], owner[back]

    def _segments(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which characters begin a segment."""
        begins = np.zeros(len(code), bool)
        begins[first] = True
        begins[1:] |= (code[1:] == _SPACE) & (code[:-1] != _SPACE)
        strange = self.single[code] < 0
        begins |= strange
        begins[1:] |= strange[:-1]
        begin = np.flatnonzero(begins)
        size = np.diff(np.r_[begin, len(code)])
        long = size > _LONG
        inner = _runs(begin[long] + 1, size[long] - 1)
        key = (code[inner - 1].astype(np.int64) << 21) | code[inner]
        at = np.minimum(np.searchsorted(self.side_by_side, key), len(self.side_by_side) - 1)
        begins[inner[self.side_by_side[at] != key]] = True
        return np.flatnonzero(begins)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, with begin and end, and where each text's ids begin (one more)."""
        marked = [chr(_SPACE) + t.replace(" ", chr(_SPACE)) if t else "" for t in texts]
        sizes = np.array([len(t) for t in marked], np.int64)
        code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        first = np.cumsum(sizes) - sizes
        if not len(code):
            ids, per_text = np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        else:
            begin = self._segments(code, first[sizes > 0])
            size = np.diff(np.r_[begin, len(code)])
            key = W.powers(W._PRIME, int(size.max()))[_runs(np.zeros(len(size), np.int64), size)]
            with np.errstate(over="ignore"):
                key = W.mix(np.add.reduceat(key * (code + np.uint64(1)), begin) + size.astype(np.uint64))
            _, chosen, back = np.unique(key, return_index=True, return_inverse=True)
            own_size = size[chosen]
            own = code[_runs(begin[chosen], own_size)]
            symbol, owner = self._merge(self.single[own], np.repeat(np.arange(len(chosen)), own_size))
            # A character without a piece is a segment of its own and turns into its bytes.
            strange = symbol < 0
            if strange.any():
                chars = "".join(map(chr, code[begin[chosen[owner[strange]]]]))
                encoded = [c.encode() for c in chars]
                count = np.ones(len(symbol), np.int64)
                count[strange] = [len(b) for b in encoded]
                owner, spread = np.repeat(owner, count), np.repeat(symbol, count)
                spread[spread < 0] = np.frombuffer(b"".join(encoded), np.uint8).astype(np.int32) + self.first_byte
                symbol = spread
            count = np.bincount(owner, minlength=len(chosen))
            ids = symbol[_runs((np.cumsum(count) - count)[back], count[back])]
            ends = np.cumsum(np.r_[0, count[back]])
            text_of = np.searchsorted(begin, np.r_[first, len(code)], "left")
            per_text = np.diff(ends[text_of])
        offsets = np.r_[0, np.cumsum(per_text + 2)]
        out = np.empty(offsets[-1], np.int32)
        out[offsets[:-1]], out[offsets[1:] - 1] = self.begin, self.end
        out[_runs(offsets[:-1] + 1, per_text)] = ids
        return out, offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each list of ids; bytes that are no UTF-8 turn into U+FFFD one by one."""
        size = self.surface_size[ids]
        flat = self.surface[_runs(self.surface_begin[ids], size)].tobytes()
        ends = np.r_[0, np.cumsum(size)][offsets]
        out = []
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            own = ids[offsets[i] : offsets[i + 1]]
            try:
                # Control ids between bytes keep these apart; plain decoding would join them.
                text = flat[a:b].decode() if self.surface_size[own[1:-1]].all() else self._repaired(own)
            except UnicodeDecodeError:
                text = self._repaired(own)
            # The space that encoding puts first goes, unless bytes came before it.
            own = own[self.surface_size[own] > 0]
            spaced = len(own) and not self.is_byte[own[0]] and own[0] != self.unknown and text.startswith(" ")
            out.append(text[1:] if spaced else text)
        return out

    def _repaired(self, ids: np.ndarray) -> str:
        out, held = [], b""
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                held += bytes([i - self.first_byte])
                continue
            while held:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(held[:size].decode())
                        held = held[size:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    held = held[1:]
            if i is not None:
                a = self.surface_begin[i]
                out.append(self.surface[a : a + self.surface_size[i]].tobytes().decode())
        return "".join(out)


def codec(model: str) -> Codec:
    """The codec of a model file, made once per process."""
    if model not in _loaded:
        _loaded[model] = Codec(model)
    return _loaded[model]


def _encoded(model: str, lists: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for part in W.slices(batch, "text", 1 << 20):
                ids, offsets = own.encode([t or "" for t in part.column("text").to_pylist()])
                texts = own.decode(ids, offsets)
                flat = ids.astype("<u4").tobytes()
                columns = [
                    part.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array([hashlib.sha256(flat[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets, offsets[1:])]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
                ]
                if lists:
                    columns += [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(texts)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return run


def encode_documents(docs: DataFrame, model: str, lists: bool = True) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded) of ``docs`` (doc_id, text).

    Ids have begin and end; a null text counts as empty. ``ids`` and ``decoded`` are left out without
    ``lists``. Every row is encoded on its own, so repeated rows give repeated results. ``model`` is a
    path that all executors know.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if lists else ""
    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(_encoded(model, lists), schema)
