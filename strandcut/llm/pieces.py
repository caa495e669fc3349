"""Operator 2: merge-type piece vocabularies by an agenda of symbol pairs."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Sequence
from heapq import heapify, heappop, heappush
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcut.llm.arrow import map_texts
from strandcut.llm.registry import query, table

SPACE = "▁"
#: Segments remembered by one task; a full memory is emptied.
MEMORY = 100_000
#: Longer segments are not remembered.
SHORT = 64
#: Pieces whose bytes are looked up at a time.
BLOCK = 1 << 18

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NO_PAIR = np.iinfo(np.int64).max


class Vocabulary:
    """Pieces and scores of a merge-type model, with its encoder and decoder.

    Refuses models that need more than this: other model types, normalisation
    rules, user symbols. Merging never crosses a place where a blank follows
    another character if no piece holds such a place, nor a line end if no
    piece holds one; texts are cut there and each segment is encoded by itself.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        trainer, rules = model.trainer_spec, model.normalizer_spec
        plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces
        if trainer.model_type != trainer.BPE or not (plain and rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("only merge-type models without normalisation rules")
        if trainer.treat_whitespace_as_suffix or not trainer.byte_fallback:
            raise ValueError("only models with blanks as prefixes and byte pieces")
        self.text = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        if set(self.kind) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with user symbols or unused pieces are not supported")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        # Equal scores have equal ranks, so that the place decides.
        order = {score: r for r, score in enumerate(sorted({p.score for p in model.pieces}, reverse=True))}
        self.rank = {p.piece: order[p.score] for p in model.pieces if p.type == NORMAL}
        self.plain = {i: p.piece.replace(SPACE, " ") for i, p in enumerate(model.pieces) if p.type == NORMAL}
        written = [
            self.plain[i].encode() if i in self.plain else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b""
            for i, p in enumerate(model.pieces)
        ]
        self.piece_data = np.frombuffer(b"".join(written), np.uint8)
        self.piece_sizes = np.array([len(w) for w in written], np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.odd_piece = np.array([p.type not in (NORMAL, BYTE) for p in model.pieces], np.int64)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        inside = [p for p in self.ids if SPACE in p.lstrip(SPACE)]
        lines = [p for p in self.ids if "\n" in p]
        if inside:
            self.cut = re.compile(r"(?s).+")
        elif lines:
            self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.cut = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self._pair_table()
        self.digits = [str(i) for i in range(len(self.text))]
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode_segment(self, segment: str) -> list[int]:
        """Merge adjacent symbols, best score first, leftmost first on ties.

        The agenda holds a pair's rank, the place of its left symbol and the
        text of both. An entry is stale once either side has been merged.
        """
        rank, n = self.rank, len(segment)
        symbols = list(segment)
        agenda = [
            (rank[both], i, both)
            for i, both in enumerate(map(str.__add__, segment, segment[1:])) if both in rank
        ]
        if agenda:
            heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while agenda:
                _, left, both = heappop(agenda)
                right = after[left]
                if not symbols[left] or right >= n or symbols[left] + symbols[right] != both:
                    continue
                symbols[left], symbols[right] = both, ""
                right = after[left] = after[right]
                if right < n:
                    before[right] = left
                    pair = both + symbols[right]
                    if pair in rank:
                        heappush(agenda, (rank[pair], left, pair))
                at = before[left]
                if at >= 0:
                    pair = symbols[at] + both
                    if pair in rank:
                        heappush(agenda, (rank[pair], at, pair))
        out: list[int] = []
        for symbol in symbols:
            if symbol:
                found = self.ids.get(symbol)
                if found is None:
                    out += [self.byte[b] for b in symbol.encode()]
                else:
                    out.append(found)
        return out

    def encode_short(self, segments: list[str]) -> list[list[int]]:
        """The same for many short segments: in each round every segment's agenda gives its best pair.

        A segment's agenda is its stretch of one array of pair ranks. Segments
        that need byte pieces go through :meth:`encode_segment`.
        """
        out: list[list[int] | None] = [None] * len(segments)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        symbols = self.of_code[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(segments)), lengths)
        ranks, merged = self._pairs(symbols, owner)
        done_owner, done_symbols = [], []
        while len(owner):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.repeat(np.minimum.reduceat(ranks, first), np.diff(np.r_[first, len(owner)]))
            over = best == NO_PAIR
            if over.any():
                done_owner.append(owner[over])
                done_symbols.append(symbols[over])
                symbols, owner, ranks, merged, best = (x[~over] for x in (symbols, owner, ranks, merged, best))
                if not len(owner):
                    break
            at = np.flatnonzero(ranks == best)
            at = at[np.r_[True, owner[at][1:] != owner[at][:-1]]]
            symbols[at] = merged[at]
            keep = np.ones(len(owner), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            symbols, owner, ranks, merged = (x[keep] for x in (symbols, owner, ranks, merged))
            for near in (at, at[at > 0] - 1):
                pair = np.minimum(near + 1, len(owner) - 1)
                ranks[near], merged[near] = self._ranked(
                    symbols[near], symbols[pair], (pair > near) & (owner[near] == owner[pair])
                )
        if done_owner:
            owners, found = np.concatenate(done_owner), np.concatenate(done_symbols)
            order = np.argsort(owners, kind="stable")
            owners, found = owners[order], found[order]
            odd = set(owners[(found < 0) | (found >= len(self.text))].tolist())
            ends = np.cumsum(np.bincount(owners, minlength=len(segments))).tolist()
            flat = found.tolist()
            start = 0
            for i, end in enumerate(ends):
                out[i] = self.encode_segment(segments[i]) if i in odd else flat[start:end]
                start = end
        return out

    def _pairs(self, symbols, owner):
        if len(symbols) < 2:
            return np.full(len(symbols), NO_PAIR), np.zeros(len(symbols), np.int64)
        ranks, merged = self._ranked(symbols[:-1], symbols[1:], owner[:-1] == owner[1:])
        return np.r_[ranks, NO_PAIR], np.r_[merged, 0]

    def _ranked(self, left, right, together):
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        good = together & (left >= 0) & (right >= 0) & (self.pair_keys[at] == keys)
        return np.where(good, self.pair_ranks[at], NO_PAIR), np.where(good, self.pair_ids[at], 0)

    def _pair_table(self) -> None:
        """All ways to make a piece of two symbols: pieces, or single characters without a piece."""
        chars = sorted({c for p in self.ids for c in p} - self.ids.keys())
        number = {**self.ids, **{c: len(self.text) + i for i, c in enumerate(chars)}}
        self.of_code = np.full(0x110000, -1, np.int64)
        for c, i in number.items():
            if len(c) == 1:
                self.of_code[ord(c)] = i
        self.width = len(self.text) + len(chars) + 1
        pairs = sorted(
            (number[p[:k]] * self.width + number[p[k:]], self.rank[p], i)
            for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number
        )
        self.pair_keys, self.pair_ranks, self.pair_ids = (np.array(x, np.int64) for x in zip(*pairs))

    def segments(self, text: str) -> list[str]:
        """The cut text: blanks escaped, one put in front; nothing for an empty text."""
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode_ids(self, ids: list[int]) -> str:
        """Pieces put together; broken byte runs become replacement characters, byte by byte."""
        return self._without_blank(self._put_together(ids), ids)

    def _without_blank(self, text: str, ids: Sequence[int]) -> str:
        """The text less the blank put in front, which belongs to the first piece that shows, if it is a plain one."""
        if text.startswith(" ") and next(k for k in map(self.kind.__getitem__, ids) if k != CONTROL) == NORMAL:
            return text[1:]
        return text

    def decode_joined(self, texts: list[str], counts: list[int]) -> list[str]:
        """:meth:`decode_ids` of many texts, each as ``counts`` decimal ids joined by commas.

        The bytes of all pieces are looked up together, block by block; texts
        with broken byte runs or other kinds of pieces go one by one.
        """
        ids = np.fromstring(",".join(filter(None, texts)) or "-1", np.int64, sep=",")[:sum(counts)]
        bounds = np.r_[0, np.cumsum(np.array(counts, np.int64))]
        at = np.r_[0, np.cumsum(self.piece_sizes[ids])][bounds].tolist()
        slow = np.r_[0, np.cumsum(self.odd_piece[ids])][bounds]
        data = b"".join(self._piece_bytes(ids[i:i + BLOCK]) for i in range(0, len(ids), BLOCK))
        out = []
        for i, odd in enumerate((slow[1:] > slow[:-1]).tolist()):
            try:
                if odd:
                    raise ValueError
                out.append(self._without_blank(data[at[i]:at[i + 1]].decode(), ids[bounds[i]:bounds[i + 1]]))
            except ValueError:
                out.append(self.decode_ids(ids[bounds[i]:bounds[i + 1]].tolist()))
        return out

    def _piece_bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.piece_sizes[ids]
        before = np.cumsum(sizes) - sizes
        places = np.arange(sizes.sum()) + np.repeat(self.piece_starts[ids] - before, sizes)
        return self.piece_data[places].tobytes()

    def _put_together(self, ids: list[int]) -> str:
        try:
            return "".join([self.plain[i] for i in ids])
        except KeyError:
            pass
        out, run = [], bytearray()
        for i in ids:
            if self.kind[i] == BYTE:
                run.append(int(self.text[i][3:5], 16))
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            out.append(self.text[i].replace(SPACE, " ") if self.kind[i] == NORMAL else " ⁇ " if self.kind[i] == UNKNOWN else "")
        if run:
            out.append(_utf8(run))
        return "".join(out)


def _utf8(run: bytearray) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[i:i + n]).decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                n = 1
                out.append("�")
            i += n
        return "".join(out)


class Encoder:
    """Encodes texts segment by segment and checks every new segment against the library.

    Remembered segments live in two generations: a full one becomes the old
    one, and what is met again moves to the new one.
    """

    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def _learn(self, segments: list[str]) -> dict[str, str]:
        v = self.v
        short = [s for s in segments if len(s) <= SHORT]
        own = dict(zip(short, v.encode_short(short)))
        own.update((s, v.encode_segment(s)) for s in segments if len(s) > SHORT)
        # The library puts a blank in front; a segment without one stands behind a line end.
        asked = v.library.encode([s[1:] if s.startswith(SPACE) else "\n" + s for s in segments], num_threads=1)
        blank = v.encode_segment(SPACE)
        line = blank + v.encode_segment("\n")
        out, digits = {}, self.v.digits
        for s, theirs in zip(segments, asked):
            ids = own[s]
            if ids != theirs and s != SPACE and (s.startswith(SPACE) or line + ids != theirs):
                raise ValueError(f"segment {s!r}: {ids}, but the library gives {theirs}")
            if v._put_together(ids) != s.replace(SPACE, " "):
                raise ValueError(f"segment {s!r} decodes to {v._put_together(ids)!r}")
            out[s] = ",".join([digits[i] for i in ids])
        return out

    def _known(self, parts: list[list[str]]) -> dict[str, str]:
        young, old = self.young, self.old
        if len(young) > MEMORY:
            self.young, self.old = young, old = {}, young
        fresh = set().union(*parts) - young.keys()
        young.update((s, old[s]) for s in fresh & old.keys())
        learnt = self._learn(list(fresh - old.keys()))
        if max(map(len, learnt), default=0) <= SHORT:
            young.update(learnt)
            return young
        young.update((s, e) for s, e in learnt.items() if len(s) <= SHORT)
        return {**young, **learnt}

    def __call__(self, rows: list[tuple]) -> list[tuple]:
        """``(doc_id, n_tokens, ids joined by commas, decoded text)`` for rows of id and text."""
        cut = [self.v.segments(text or "") for _, text in rows]
        known = self._known(cut).__getitem__
        joined = [",".join(map(known, parts)) for parts in cut]
        counts = [ids.count(",") + 1 if ids else 0 for ids in joined]
        out = [(row[0], *got) for row, got in zip(rows, zip(counts, joined, self.v.decode_joined(joined, counts)))]
        if rows:
            # One whole text of each slice, end to end.
            theirs = self.v.library.encode(rows[0][1] or "")
            if (",".join(map(str, theirs)), self.v.library.decode(theirs)) != out[0][2:]:
                raise ValueError(f"the text of document {rows[0][0]} differs from the library's")
        return out


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, kept from task to task.

    Kernels come with each task, so module variables do not last; ``sys.modules`` does.
    """
    held = sys.modules.setdefault("strandcut_encoders", ModuleType("strandcut_encoders"))
    if path not in vars(held):
        setattr(held, path, Encoder(path))
    return getattr(held, path)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
DIGEST_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
])
TOKENS = "doc_id bigint, n_tokens bigint, ids array<int>, decoded string"
TOKENS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string()),
])


def encode_texts(
    docs: DataFrame, path: str, *, digests: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Ids of every whole text and the text decoded from them, or their SHA-256 digests.

    Without begin and end ids. Null and empty texts have no ids and decode to
    an empty text. Rows may repeat; other columns are left out; an empty table
    gives no rows. Every distinct segment a task meets is encoded by the agenda
    and compared with the sentencepiece library in one call per batch, ids and
    decoded text alike, and so is one whole text per slice of a batch; a
    difference ends the job. The text is decoded from the ids of the whole
    document. ``path`` names the model on every executor.
    """
    def make():
        encode = encoder(path)
        if digests:
            return lambda rows: [(d, n, _sha(ids), _sha(text)) for d, n, ids, text in encode(rows)]
        return lambda rows: [
            (d, n, np.array(ids.split(",") if ids else [], np.int32), text) for d, n, ids, text in encode(rows)
        ]

    shape = (DIGEST, DIGEST_ARROW) if digests else (TOKENS, TOKENS_ARROW)
    return map_texts(docs.select(F.col(id_col), F.col(text_col)), make, *shape)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op2_sentencepiece")
def sentencepiece_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), model_path(), digests=True)
