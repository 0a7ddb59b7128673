"""Exact byte-level BPE ids, with the pieces of many texts looked up before they are encoded.

The tokenizer never joins a character that is not white space with white space after it, nor
characters of two of the kinds letter, digit and punctuation mark (but for an apostrophe and
letters). A text can therefore be cut at those places. The pieces of a batch are slices of its
Arrow buffer: equal ones are found and known ones looked up by Arrow, and only new ones are
encoded. The memory of pieces is bounded; those used last stay.
"""

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pulsemill.llm.worker import kept

TOKENIZER = "byte_bpe_50k.json"
PIECES_KEPT, LONGEST_KEPT, BYTES_AT_ONCE, WORDS_AT_ONCE = 400_000, 60, 4_000_000, 6

# Kinds of bytes. OTHER is anything that may be white space, SOLID a character that is not white space
# and of no kind that texts are cut by. Only letters that all versions of Unicode agree on are LETTERs.
OTHER, LETTER, DIGIT, MARK, APOSTROPHE, SOLID, BREAK, BLANK = range(8)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _kind_of_bytes() -> np.ndarray:
    """Kinds of ASCII characters, and of others by their first byte."""
    kind = np.zeros(256, np.uint8)
    for b in range(33, 127):
        c = chr(b)
        kind[b] = LETTER if c.isalpha() else DIGIT if c.isdigit() else APOSTROPHE if c == "'" else MARK
    kind[[9, 10, 13]], kind[32] = BREAK, BLANK
    kind[0xC3:0xE1] = kind[0xE4:0xEE] = kind[0xF0:0xF5] = SOLID
    kind[0xC3:0xCA] = kind[0xD0:0xD2] = LETTER
    return kind


def _cut_of_pairs() -> np.ndarray:
    """For two neighbouring kinds: 1 for a cut between them, 2 for one before the first."""
    cut = np.zeros((8, 8), np.uint8)
    solid = [LETTER, DIGIT, MARK, APOSTROPHE, SOLID]
    for a in solid:
        cut[a, [BREAK, BLANK]] = 1
    cut[BLANK, solid], cut[BREAK, solid] = 2, 3
    cut[LETTER, [DIGIT, MARK, APOSTROPHE]] = cut[DIGIT, [LETTER, MARK, APOSTROPHE]] = 1
    cut[MARK, [LETTER, DIGIT]] = cut[APOSTROPHE, DIGIT] = 1
    return cut.reshape(-1)


def _letters_of_bytes() -> np.ndarray:
    """Code points of the letters that the byte-level alphabet writes for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    out = np.arange(256, dtype="<u4")
    out[rest] = 256 + np.arange(len(rest))
    return out


_KIND, _CUT, _LETTERS = _kind_of_bytes(), _cut_of_pairs(), _letters_of_bytes()
_BETWEEN = b"\xff"  # no text holds this byte


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, equal to encoding the text at once.

    Texts that hold the string of an added token are encoded at once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # pieces are kept here
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letter = chr(_LETTERS[_BETWEEN[0]])
        holding = [i for t, i in self.tokenizer.get_vocab().items() if letter in t]
        # where no merge takes that letter, words can be merged side by side
        self.between = holding[0] if len(holding) == 1 else None
        self.pieces = self.ids = pa.array([], pa.large_binary())

    def plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts) -> list:
        """Ids of some texts (a list or an Arrow array); none for NULL."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        texts = texts.cast(pa.large_string()).fill_null("")
        at_once = np.zeros(len(texts), bool)
        for a in self.added:
            at_once |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        held = {i: self.plain(texts[i].as_py()) for i in np.flatnonzero(at_once).tolist()}
        if held:
            texts = pc.if_else(pa.array(at_once), "", texts)
        edges, data = _buffers(texts)
        if not len(data):
            return [held.get(i, b"") for i in range(len(texts))]
        starts = _cuts(data, edges)
        pieces = _binary(np.append(starts, len(data)), data).dictionary_encode()
        at, raw = _buffers(self._lookup(pieces.dictionary).take(pieces.indices))
        at, raw = at[np.searchsorted(starts, edges)].tolist(), raw.tobytes()
        return [held[i] if i in held else raw[a:b] for i, (a, b) in enumerate(zip(at, at[1:]))]

    def _lookup(self, pieces):
        """Ids of different pieces. New ones are encoded, and what was not used for longest is forgotten."""
        at = pc.index_in(pieces, value_set=self.pieces)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        new = np.flatnonzero(missing)
        at[new] = len(self.pieces) + np.arange(len(new))
        ids = pa.concat_arrays([self.ids, self._encode(pieces.take(pa.array(new)))]).take(pa.array(at))
        idle = np.ones(len(self.pieces), bool)
        idle[at[~missing]] = False
        short = pc.less_equal(pc.binary_length(pieces), LONGEST_KEPT)
        idle = pa.array(idle)
        self.pieces, self.ids = (
            pa.concat_arrays([now.filter(short), before.filter(idle)])[:PIECES_KEPT]
            for now, before in ((pieces, self.pieces), (ids, self.ids)))
        return ids

    def _encode(self, pieces):
        """Ids of different pieces, those of one kind of characters without the search for words."""
        edges, data = _buffers(pieces)
        word = np.zeros(len(pieces), bool)
        if self.between is not None and len(pieces):
            kinds = _kinds(data)
            first = edges[:-1] + ((kinds[edges[:-1]] == BLANK) & (np.diff(edges) > 1))
            kind = kinds[first]
            # every byte behind the first is like the one before it
            changes = np.append(0, np.cumsum(kinds[1:] != kinds[:-1]))
            word = np.isin(kind, (LETTER, DIGIT, MARK)) & (changes[edges[1:] - 1] == changes[first])
        words, others = (pieces.filter(pa.array(m)) for m in (word, ~word))
        made = [self._encode_words(words)]
        for lo in range(0, len(others), 1000):
            part = others[lo:lo + 1000].cast(pa.large_string()).to_pylist()
            made.append(pa.array([np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(
                part, add_special_tokens=False)], pa.large_binary()))
        order = np.argsort(np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)]))
        return pa.concat_arrays(made).take(pa.array(order))

    def _encode_words(self, words):
        """Some words are merged side by side, with a byte between them that nothing merges with."""
        if not len(words):
            return pa.array([], pa.large_binary())
        letters = _LETTERS[np.frombuffer(_BETWEEN.join(words.to_pylist()), np.uint8)].tobytes().decode("utf-32-le")
        between = chr(_LETTERS[_BETWEEN[0]])
        letters, merged, ids = letters.split(between), self.model.tokenize, []
        for lo in range(0, len(letters), WORDS_AT_ONCE):
            ids += [t.id for t in merged(between.join(letters[lo:lo + WORDS_AT_ONCE]))]
            ids.append(self.between)
        ids = np.array(ids, "<u4")
        ends = np.flatnonzero(ids == self.between)
        if len(ends) != len(words):
            raise ValueError("words were not kept apart")
        edges = np.append(0, ends - np.arange(len(ends))) * 4
        return _binary(edges, ids[ids != self.between].view(np.uint8))


def _binary(edges, data):
    edges = np.ascontiguousarray(edges, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])


def _buffers(array):
    """Edges of the values of a large binary or string array without NULLs, from 0, and the bytes."""
    _, edges, data = array.buffers()
    if not len(array):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    edges = np.frombuffer(edges, np.int64)[array.offset:array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    return edges - edges[0], data


def _kinds(data) -> np.ndarray:
    """Kinds of the bytes of UTF-8; all bytes of a character have its kind."""
    kinds = _KIND[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        kinds[lead[(data[lead] == 0xC3) & np.isin(data[np.minimum(lead + 1, len(data) - 1)], (0x97, 0xB7))]] = SOLID
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            lead = lead[data[lead] >= least]
            lead = lead[lead + k < len(data)]
            kinds[lead + k] = kinds[lead]
    return kinds


def _cuts(data, edges) -> np.ndarray:
    """Where the pieces of texts that stand side by side start."""
    kinds = _kinds(data)
    pairs = _CUT[(kinds[:-1] << 3) | kinds[1:]]
    ends = edges[(edges > 0) & (edges < len(data))]
    pairs[ends - 1] = 0
    cut = np.zeros(len(data), bool)
    cut[1:] = pairs & 1
    cut[:-1] |= pairs > 1
    cut[ends] = cut[0] = True
    return np.flatnonzero(cut)


def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def encoded(enc: Encoder, batch):
    """(doc_id, ids) of every row of an Arrow batch with doc_id and text."""
    ids, texts = batch.column("doc_id"), batch.column("text")
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = int(sizes[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, before + BYTES_AT_ONCE, "right")))
        yield from zip(ids[lo:hi].to_pylist(), enc.encode_all(texts[lo:hi]))
        lo = hi
