"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is read with blanks as the model's blank sign and one blank before it. Its lattice has an arc for each piece of
the vocabulary at each place where it occurs; a character that no piece holds is spelled in byte pieces, and so is a
blank sign that the text itself holds. A piece weighs exp(temperature * log p): log p is the model's score, or, for a
model whose scores are ranks (byte-pair encoding), that of Zipf's law at the rank. Forward filtering gives every place
the total weight of the ways to it; backward sampling draws the last arc in proportion, again and again. The draws come
from hashes of the row key, so a row has the same pieces on every run and cluster.

No piece holds a blank sign after another character, and some characters (line feeds) are in no piece at all, so the
lattice falls into independent chunks there. Each distinct chunk is filtered once while it is held in memory, and
sampled for all its places at once; a model with such pieces is refused.

Nulls and edges: a null text has null pieces and decodes to null; an empty text has none and decodes to the empty text;
a null key counts as the empty text; equal texts under one key have equal pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talweg.llm.common import blocks, code_points, small

MODEL, TEMPERATURE, SEED = "/opt/tokenizers/piece_bpe_32k.model", 1.0, 17
#: Characters of text coded at once, characters of new chunks filtered at once, and places of filtered chunks held.
BLOCK_CHARS, FILTER_CHARS, HELD_NODES = 1 << 18, 1 << 16, 1 << 20
_BLANK = 0x2581
#: What a byte-spelled character costs beside the rarest piece.
_SPELLED = 10.0
_CHUNKS = re.compile(r" +[^ \n]*|[^ \n]+|\n")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _by(key: np.ndarray, below: int) -> np.ndarray:
    """Stable order of keys in [0, below); small ranges are sorted by radix."""
    return np.argsort(key.astype(np.uint16) if below <= 1 << 16 else key, kind="stable")


class Vocabulary:
    """Pieces of a model as a trie over code points, with weights, and their bytes."""

    def __init__(self, model: bytes, temperature: float = TEMPERATURE):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        names = {i: sp.id_to_piece(i) for i in plain}
        sign = chr(_BLANK)
        if any(sign in p.lstrip(sign) or "\n" in p for p in names.values()):
            raise ValueError("a piece holds a blank after another character, or a line feed")
        score = np.array([sp.get_score(i) for i in plain])
        ranks = bool(len(score)) and float(score.min()) < -1000
        log_p = -np.log(1.0 - score + 1.0) if ranks else score
        self.weight = np.zeros(n)
        self.weight[plain] = temperature * log_p
        self.spelled = float(temperature * log_p.min() - _SPELLED) if len(log_p) else -_SPELLED
        byte_ids = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        self.byte_id = np.array([byte_ids[f"<0x{b:02X}>"] for b in range(256)], np.int32)
        # The trie: keys (node << 21 | code point) in order, the nodes they lead to, and the piece that ends at a node.
        nodes: dict[tuple[int, int], int] = {}
        piece = [-1]
        for i in plain:
            at = 0
            for ch in names[i]:
                key = (at, ord(ch))
                if key not in nodes:
                    nodes[key] = len(piece)
                    piece.append(-1)
                at = nodes[key]
            if piece[at] < 0:
                piece[at] = i
        keys = np.array([(a << 21) | c for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.key, self.node = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.piece = np.array(piece, np.int64)
        self.key = np.r_[self.key, np.iinfo(np.int64).max]
        #: The trie's first step by code point, as every place takes it; -1: none.
        self.first = np.full(0x110001, -1, np.int32)
        self.first[[c for a, c in nodes if a == 0]] = [k for (a, _), k in nodes.items() if a == 0]
        # Bytes of every piece, end to end.
        each = [names[i].replace(sign, " ").encode() if i in names else b"" for i in range(n)]
        for b in range(256):
            each[self.byte_id[b]] = bytes([b])
        self.bytes = np.frombuffer(b"".join(each) + b"\0", np.uint8)
        self.length = np.array([len(e) for e in each], np.int64)
        self.at = np.r_[0, np.cumsum(self.length)[:-1]]

    def arcs(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of every arc, but for spelled characters the longer first; room: places from each to its chunk's end. Piece -1 - c spells character c."""
        at = self.first[codes].astype(np.int64)
        start = np.flatnonzero(at >= 0)
        at = at[start]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        single = np.zeros(len(codes), bool)
        depth = 1
        while len(start):
            ends = self.piece[at] >= 0
            found.append((start[ends], np.full(int(ends.sum()), depth), self.piece[at[ends]]))
            if depth == 1:
                single[start[ends]] = True
            more = room[start] > depth
            start, at = start[more], at[more]
            key = (at << 21) | codes[start + depth]
            k = np.searchsorted(self.key, key)
            ok = self.key[k] == key
            start, at = start[ok], self.node[k[ok]]
            depth += 1
        alone = np.flatnonzero(~single)
        found.append((alone, np.ones(len(alone), np.int64), -1 - codes[alone]))
        return tuple(np.concatenate(x) for x in zip(*found[::-1], strict=True))  # type: ignore[return-value]


class Lattices:
    """Filtered lattices of distinct chunks: a node for each place, arcs by node with cumulative shares."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.n_nodes = self.n_arcs = 0
        #: First and last node by chunk, first arc by node; by arc its cumulative share, length and piece.
        self.first, self.last = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.begin, self.share = np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.float32)
        self.step, self.arc = np.zeros(1 << 18, np.int16), np.zeros(1 << 18, np.int32)

    def _put(self, names: tuple[str, ...], at: int, values: tuple[np.ndarray, ...]) -> None:
        for name, value in zip(names, values, strict=True):
            whole = getattr(self, name)
            if at + len(value) > len(whole):
                wide = np.zeros(at + len(value) + at // 2, whole.dtype)
                wide[:at] = whole[:at]
                setattr(self, name, wide)
                whole = wide
            whole[at : at + len(value)] = value

    def add(self, chunks: list[str]) -> None:
        """Filters the chunks that are not held."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.index]
        for lo, hi in blocks([len(c) for c in new], FILTER_CHARS):
            self._filter(new[lo:hi])

    def _filter(self, new: list[str]) -> None:
        codes, offsets = code_points(new)
        codes = codes.astype(np.int64)
        codes = np.where(codes == _BLANK, 0x110000, np.where(codes == 32, _BLANK, codes))
        size = np.diff(offsets)
        chunk = np.repeat(np.arange(len(new)), size)
        room = offsets[1:][chunk] - np.arange(len(codes))
        start, length, piece = self.vocabulary.arcs(codes, room)
        # By the place that an arc ends at, longer arcs first: they are the likelier ones, so that a draw looks at few.
        order = _by(start + length - 1, len(codes))
        start, length, piece = start[order], length[order], piece[order]
        weight = np.where(piece >= 0, self.vocabulary.weight[np.maximum(piece, 0)], self.vocabulary.spelled)
        end = start + length - 1
        begins = start == offsets[chunk[start]]
        depth = end - offsets[chunk[start]]
        by_depth = _by(depth, int(size.max()))
        cuts = np.searchsorted(depth[by_depth], np.arange(int(size.max()) + 1))
        total = np.zeros(len(codes))
        value = np.empty(len(start))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            at = by_depth[lo:hi]
            e = end[at]
            v = weight[at] + np.where(begins[at], 0.0, total[start[at] - 1])
            groups = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
            top = np.maximum.reduceat(v, groups)
            wide = np.diff(np.r_[groups, len(v)])
            p = np.exp(v - np.repeat(top, wide))
            s = np.add.reduceat(p, groups)
            total[e[groups]] = top + np.log(s)
            value[at] = p / np.repeat(s, wide)
        groups = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
        running = np.cumsum(value)
        share = running - np.repeat(running[groups] - value[groups], np.diff(np.r_[groups, len(end)]))
        share[np.r_[groups[1:], len(end)] - 1] = 2.0
        self._put(("share", "step", "arc"), self.n_arcs, (share, length, piece))
        self._put(("begin",), self.n_nodes, (groups + self.n_arcs,))
        self.n_arcs += len(end)
        self._put(("first", "last"), len(self.index), (offsets[:-1] + self.n_nodes, offsets[1:] + self.n_nodes - 1))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.n_nodes += len(codes)

    def sample(self, chunks: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs' pieces of all chunks end to end, and how many each has; seeds: uint64 for each chunk."""
        at = np.array([self.index[c] for c in chunks], np.int64)
        first, node = self.first[at], self.last[at].astype(np.int64)
        who = np.arange(len(chunks))
        count = np.zeros(len(chunks), np.int64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            u = (_mixed(seeds[who] + np.uint64((len(steps) + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            k = self.begin[node].astype(np.int64)
            short = np.flatnonzero(self.share[k] <= u)
            while len(short):
                k[short] += 1
                short = short[self.share[k[short]] <= u[short]]
            steps.append((who, self.arc[k]))
            count[who] += 1
            node = node - self.step[k]
            more = node >= first[who]
            who, node = who[more], node[more]
        place = np.r_[0, np.cumsum(count)]
        out = np.zeros(int(place[-1]), np.int64)
        for t, (w, piece) in enumerate(steps):
            out[place[w] + count[w] - 1 - t] = piece
        return out, count


class Coder:
    """Encodes and decodes lists of texts."""

    def __init__(self, model: bytes, temperature: float = TEMPERATURE, seed: int = SEED):
        self.vocabulary = Vocabulary(model, temperature)
        self.lattices = Lattices(self.vocabulary)
        self.seed = seed

    def encode(self, texts: list[str], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids (int32) of all texts end to end, and the len(texts) + 1 offsets between them."""
        parts, counts = [], []
        for lo, hi in blocks([len(t) for t in texts], BLOCK_CHARS):
            lists = [_CHUNKS.findall(" " + t) if t else [] for t in texts[lo:hi]]
            n = np.array([len(x) for x in lists], np.int64)
            chunks = [c for x in lists for c in x]
            if not chunks:
                counts.append(np.zeros(hi - lo, np.int64))
                continue
            if self.lattices.n_nodes > HELD_NODES:
                self.lattices.clear()
            self.lattices.add(chunks)
            key = np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), self.seed) for k in keys[lo:hi]], np.uint64)
            at = np.arange(len(chunks)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
            seeds = _mixed(np.repeat(key, n) ^ (at.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            pieces, of_chunk = self.lattices.sample(chunks, seeds)
            text_of_chunk = np.repeat(np.arange(hi - lo), n)
            ids, of_piece = self._spell(pieces)
            text_of_piece = np.repeat(text_of_chunk, of_chunk)
            parts.append(ids)
            counts.append(np.bincount(text_of_piece, of_piece, hi - lo).astype(np.int64))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return ids, np.r_[0, np.cumsum(np.concatenate(counts))] if counts else np.zeros(1, np.int64)

    def _spell(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces for the characters that are spelled; how many ids stand for each piece."""
        spelled = np.flatnonzero(pieces < 0)
        n = np.ones(len(pieces), np.int64)
        if not len(spelled):
            return pieces.astype(np.int32), n
        code = -1 - pieces[spelled]
        code = np.where(code == 0x110000, _BLANK, code)
        n[spelled] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        out = np.repeat(pieces, n)
        at = (np.cumsum(n) - n)[spelled]
        data = np.frombuffer("".join(map(chr, code.tolist())).encode("utf-8", "surrogatepass"), np.uint8)
        where = np.repeat(at, n[spelled]) + (np.arange(len(data)) - np.repeat(np.r_[0, np.cumsum(n[spelled])[:-1]], n[spelled]))
        out[where] = self.vocabulary.byte_id[data]
        return out.astype(np.int32), n

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of piece ids between the offsets."""
        v = self.vocabulary
        out = []
        for lo, hi in blocks(np.diff(offsets).tolist(), BLOCK_CHARS):
            part = ids[offsets[lo] : offsets[hi]]
            n = v.length[part]
            ends = np.r_[0, np.cumsum(n)]
            data = v.bytes[np.repeat(v.at[part] - ends[:-1], n) + np.arange(int(ends[-1]))].tobytes()
            cut = ends[offsets[lo : hi + 1] - offsets[lo]].tolist()
            out += [data[a + 1 : b].decode("utf-8", "surrogatepass") if b > a else "" for a, b in zip(cut, cut[1:], strict=False)]
        return out


@lru_cache(maxsize=2)
def coder(model: bytes, temperature: float, seed: int) -> Coder:
    return Coder(model, temperature, seed)


def load(path: str = MODEL) -> bytes:
    """The model's bytes, read on the driver and sent with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", name: str = "pieces", lossless: str | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """docs with an array of sampled piece ids, and, under the name `lossless`, whether they decode to the text; columns of
    these names are replaced."""
    keep = [c for c in docs.columns if c not in (name, lossless)]
    given = docs.select(*keep, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key"))
    schema = T.StructType([*docs.select(*keep).schema, T.StructField(name, T.ArrayType(T.IntegerType()))])
    if lossless:
        schema = schema.add(lossless, T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model, temperature, seed)
        for batch in small(batches, text, BLOCK_CHARS):
            texts, keys = batch.column(text).to_pylist(), batch.column("__key").to_pylist()
            body = [t or "" for t in texts]
            ids, offsets = c.encode(body, keys)
            same = [pa.array([a == b for a, b in zip(c.decode(ids, offsets), body, strict=True)])] if lossless else []
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], lists, *same], schema.names)
        c.lattices.clear()  # the worker may serve other tasks

    return given.mapInArrow(run, schema)


def decode(docs: DataFrame, model: bytes, pieces: str = "pieces", name: str = "decoded") -> DataFrame:
    """docs with the texts of their pieces; a column of that name is replaced."""
    keep = [c for c in docs.columns if c != name]
    schema = T.StructType([*docs.select(*keep).schema, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model, TEMPERATURE, SEED)
        for batch in small(batches, pieces):
            lists = batch.column(pieces)
            n = np.array([x or 0 for x in lists.value_lengths().to_pylist()], np.int64)
            texts = c.decode(lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(n)])
            found = [t if known else None for t, known in zip(texts, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(found, pa.string())], [*keep, name])

    return docs.mapInArrow(run, schema)
