"""Tokenizing Arrow batches with the tokenizers library, each distinct chunk of text once.

A chunk starts at white space after another character, and at ASCII punctuation
after an ASCII letter or digit.  No pattern of the supported vocabularies matches
across the start of a chunk (matches have white space only in front, and letters
and digits never go on with punctuation), so the ids of a text are those of its
chunks in order.  Chunks are found and made distinct in Arrow and numpy; only
new ones reach the tokenizer.
"""

from __future__ import annotations

import base64
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import LOWER, SLICE_BYTES, WHITE, ranges, raw_of, slices

# a task has one core: the library's own threads would only wait for each other
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space that is not one byte; texts with it are encoded whole, as a run of mixed white space may be cut in its midst.
WIDE_SPACE = "[\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def byte_chars() -> dict[int, str]:
    """The usual one-to-one table of bytes and printable characters: printable Latin-1 stands for itself, the rest follows from U+0100."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each token of several bytes is merged from, in order of rank: its state just before its own merge."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= rank:
                raise ValueError(f"rank {rank} can't be reached by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out.append((parts[0], parts[1]))
    return out


def byte_bpe(ranks_path: str, pattern: str):
    """A tokenizer of the tokenizers library with the given ranks as ids, each match of ``pattern`` separately."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    ranks, char = read_ranks(ranks_path), byte_chars()
    show = lambda token: "".join(char[b] for b in token)
    out = Tokenizer(models.BPE({show(t): r for t, r in ranks.items()}, [(show(a), show(b)) for a, b in merges_of(ranks)]))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    out.decoder = decoders.ByteLevel()
    return out


PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class ChunkEncoder:
    """Encodes string arrays, each distinct chunk once while it is remembered.

    Texts that match ``whole`` aren't cut into chunks.  With ``bare``, for
    vocabularies that drop white space and lower case, chunks have neither white
    space nor capitals A-Z.
    """

    def __init__(self, tokenizer, whole: str, bare: bool = False, remember: int = 1_000_000):
        self.tokenizer, self.whole, self.bare, self.remember = tokenizer, whole, bare, remember
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def look_up(self, chunks: pa.StringArray) -> np.ndarray:
        """Where each of the distinct chunks is among the known ones; new ones are encoded first."""
        at = pc.index_in(chunks, value_set=self.known)
        if at.null_count:
            if len(self.known) + at.null_count > self.remember and len(self.known):
                self.forget()
                return self.look_up(chunks)
            new = chunks.filter(at.is_null())
            ids, lengths = array("I"), array("q")
            for first in range(0, len(new), 20_000):
                for e in self.tokenizer.encode_batch_fast(new.slice(first, 20_000).to_pylist(), add_special_tokens=False):
                    found = e.ids
                    ids.extend(found)
                    lengths.append(len(found))
            before = len(self.known)
            self.known = pa.concat_arrays([self.known, new])
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.frombuffer(lengths, np.int64))))
            self.ids = np.concatenate((self.ids, np.frombuffer(ids, np.uint32)))
            missing = at.is_null().to_numpy(zero_copy_only=False)
            at = at.fill_null(0).to_numpy().astype(np.int64)
            at[missing] = before + np.arange(len(new))
            return at
        return at.to_numpy().astype(np.int64)

    def chunks(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """All chunks, and the index of each text's first one (one more at the end)."""
        data, offsets = raw_of(texts)
        white = WHITE[data]
        edge = np.zeros(len(data), bool)
        edge[1:] = PUNCTUATION[data[1:]] & ALPHANUMERIC[data[:-1]]
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        if self.bare:
            edge[1:] |= white[:-1]
            edge &= ~white
            starts = np.flatnonzero(edge)
            kept = np.concatenate((np.zeros(1, np.int32), np.cumsum(~white, dtype=np.int32)))
            bounds, data = np.append(kept[starts], kept[-1]), LOWER[data[~white]]
        else:
            edge[1:] |= white[1:] & ~white[:-1]
            starts = np.flatnonzero(edge)
            bounds, data = np.append(starts, len(data)), np.ascontiguousarray(data)
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))
        return chunks, np.searchsorted(starts, offsets)

    def batches(self, texts: pa.StringArray):
        """(first row, last row, ids, offset of each text's first id and one more) of slices of bounded size."""
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        for low, high in slices(texts, 3 * SLICE_BYTES):
            part, odd = texts.slice(low, high - low), whole[low:high]
            chunks, at = self.chunks(part if not odd.any() else pc.if_else(pa.array(odd), "", part))
            coded = chunks.dictionary_encode()
            place = self.look_up(coded.dictionary)
            first, length = self.ends[:-1][place], np.diff(self.ends)[place]
            index = coded.indices.to_numpy()
            for a, b in slices(part):
                own = index[at[a] : at[b]]
                each = length[own]
                ends = np.concatenate(([0], np.cumsum(each)))
                ids, where = self.ids[ranges(first[own], each)], ends[at[a : b + 1] - at[a]]
                yield low + a, low + b, *(self.with_whole(ids, where, part, odd, a, b) if odd[a:b].any() else (ids, where))

    def with_whole(self, ids, where, part, odd, a, b) -> tuple[np.ndarray, np.ndarray]:
        parts = [ids[where[i] : where[i + 1]] for i in range(b - a)]
        for i in np.flatnonzero(odd[a:b]):
            parts[i] = np.array(self.tokenizer.encode(part[a + int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


#: Encoders of this worker process by name, so that later tasks find chunks that earlier ones encoded.
ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder_for(name: tuple, make, whole: str, bare: bool = False) -> ChunkEncoder:
    if name not in ENCODERS:
        ENCODERS[name] = ChunkEncoder(make(), whole, bare)
    return ENCODERS[name]


class ByteDecoder:
    """Turns ids back into bytes by a table; characters split between ids come together again."""

    def __init__(self, vocabulary: dict[int, bytes]):
        size = max(vocabulary, default=-1) + 1
        tokens = [vocabulary.get(i, b"") for i in range(size)]
        self.length = np.fromiter(map(len, tokens), np.int32, size)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    @classmethod
    def of(cls, tokenizer) -> "ByteDecoder":
        """Reverses the table of bytes and characters for every token of a byte-level vocabulary."""
        back = {c: b for b, c in byte_chars().items()}
        return cls({i: bytes(back[c] for c in token) for token, i in tokenizer.get_vocab().items()})

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and the offset of each text's first byte (one more at the end)."""
        lengths = self.length[ids]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return self.bytes[ranges(self.start[ids], lengths)], ends[offsets]

    def pieces(self, ids: list[int]) -> list[str]:
        """Text of each id in turn; the bytes of an unfinished character wait for the ids that end it, broken ones become U+FFFD."""
        import codecs

        reader = codecs.getincrementaldecoder("utf-8")("replace")
        out = [reader.decode(self.bytes[self.start[i] : self.start[i] + self.length[i]].tobytes()) for i in ids]
        rest = reader.decode(b"", True)
        return out[:-1] + [out[-1] + rest] if out else out
