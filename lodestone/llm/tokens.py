"""Token ids of whole texts by the tokenizers library, with a memo for the stretches that texts share.

A text falls into stretches that the tokenizer treats apart whatever stands beside them: for the byte-level file,
cuts are before single spaces and around single newlines; for the word file, which drops white space, at spaces
and newlines. A text with two white-space characters in a row (byte-level), where the cuts would not hold, goes to
the library as one piece. When the memo holds MEMO stretches it becomes the older memo, from which a stretch met
again is taken over, and the older one before it goes: that bounds its memory and keeps what is common.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO, BLOCK = 400_000, 128
#: A Latin letter and then one full stop or comma before white space are always apart: the cut there leaves the word by itself.
#: (Other letters, İ too, may normalise to a letter and a mark, which goes with the punctuation.)
ENDED = {
    False: (r"([A-Za-zÀ-ÖØ-öø-įı-ɏ])([.,])([ \n]|$)", "\\1\0\\2\\3"),
    True: (r"([A-Za-zÀ-ÖØ-öø-įı-ɏ])([.,])([ \n]|$)", r"\1 \2\3"),
}
#: Texts of a call to encode(), about: enough of them to share most of their stretches.
TEXTS = 1024
#: Two white-space characters in a row, or the character that marks cuts.
ODD = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}|\x00"


class Encoder:
    """encode(texts) returns each text's ids as little-endian 16-bit integers, or 32-bit for large vocabularies."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # the word file's normalizer makes white space a mere separator; the byte-level file has none
        self.separates = self.tokenizer.normalizer is not None
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # what stands between joined stretches: a token that touches neither side
        self.mark, self.between = ("\x02", " \x02 ") if self.separates else ("\n", "\n")
        ids = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = ids[0] if len(ids) == 1 else -1

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        texts = pc.replace_substring_regex(texts, *ENDED[self.separates])
        if self.separates:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")

    def _learn(self, stretches: list[str]) -> dict[str, bytes]:
        """Ids of each stretch. Most go to the library joined by a mark, BLOCK at a time, and are cut at the mark's id."""
        batch = self.tokenizer.encode_batch_fast
        out, plain, other = {}, [], []
        for s in stretches:
            (plain if s and self.mark not in s and (self.separates or (s[0] == " " and not s.isspace())) else other).append(s)
        blocks = [plain[i : i + BLOCK] for i in range(0, len(plain), BLOCK)]
        for block, e in zip(blocks, batch([self.between.join(x) + self.between for x in blocks], add_special_tokens=False)):
            ids = np.array(e.ids, dtype=self.dtype)
            ends = np.nonzero(ids == self.mark_id)[0].tolist()
            if len(ends) != len(block):
                other += block
                continue
            raw, size, at = ids.tobytes(), ids.itemsize, 0
            for s, end in zip(block, ends):
                out[s] = raw[at * size : end * size]
                at = end + 1
        out.update((s, np.array(e.ids, dtype=self.dtype).tobytes()) for s, e in zip(other, batch(other, add_special_tokens=False)))
        return out

    def _known(self, stretches: list[str]) -> list[bytes]:
        """Ids of distinct stretches, by the memo as far as it goes."""
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        memo = self.memo
        found = list(map(memo.get, stretches))
        missing = [i for i, v in enumerate(found) if v is None]
        if not missing:
            return found
        wanted = [stretches[i] for i in missing]
        got = list(map(self.older.get, wanted))
        new = [s for s, v in zip(wanted, got) if v is None]
        if new:
            learnt = self._learn(new)
            got = [learnt[s] if v is None else v for s, v in zip(wanted, got)]
        for i, v in zip(missing, got):
            found[i] = v
        memo.update(zip(wanted, got) if max(map(len, wanted)) < 64 else [(s, v) for s, v in zip(wanted, got) if len(s) < 64])
        return found

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """A text's stretches are told apart by Arrow's dictionary: Python meets each distinct stretch of `texts` once."""
        texts = (pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts).cast(pa.large_string())
        out: list[bytes] = [b""] * len(texts)
        odd = np.zeros(len(texts), bool) if self.separates else np.asarray(pc.match_substring_regex(texts, ODD))
        whole = np.nonzero(odd)[0].tolist()
        if whole:
            own = texts.take(pa.array(whole)).to_pylist()
            distinct = list(dict.fromkeys(own))
            ids = dict(zip(distinct, self._known(distinct)))
            for i, text in zip(whole, own):
                out[i] = ids[text]
        places = np.nonzero(~odd)[0]
        cut = self._cut(texts.filter(pa.array(~odd)) if whole else texts)
        coded = cut.flatten().dictionary_encode()
        ids = pa.array(self._known(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        # the ids of all stretches now stand in one buffer, in order
        stretch_ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset) if len(ids) else np.zeros(1, np.int64)
        text_ends = stretch_ends[np.concatenate([[0], np.cumsum(np.asarray(cut.value_lengths()))])].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        for i, lo, hi in zip(places.tolist(), text_ends, text_ends[1:]):
            out[i] = bytes(data[lo:hi])
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and file: its memo outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
