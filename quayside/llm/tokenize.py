"""Token ids of whole texts, by the tokenizers library with a memory of words."""

from __future__ import annotations

import os
from functools import cache

import numpy as np

#: Words remembered in a Python worker; then the memory is emptied.
REMEMBERED = 1_000_000
#: Words that the library encodes at once.
JOINED = 5_000
#: Punctuation that may follow a word of letters.
TAIL = b".,;:!?|*$%&#\"')-"
PUNCTUATION = TAIL.decode()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TokenIds:
    """Ids of texts as little-endian unsigned 32-bit integers.

    A vocabulary with an end-of-word suffix drops white space and never looks across it, so a
    text's ids are those of its words one after another, and words are encoded once.  Only
    ASCII white space is split at here; the library itself sees the rest.  Letters followed by
    punctuation are two pre-tokens to such a vocabulary, so the letters are looked up alone.
    Any other vocabulary encodes whole texts.
    """

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.known: dict[bytes, bytes] | None = {} if suffix else None
        if suffix:
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _plain(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _letters(self, words: list[bytes]) -> None:
        """Remembers words of letters only, each of which is one pre-token with one end."""
        for lo in range(0, len(words), JOINED):
            part = words[lo : lo + JOINED]
            ids = self._ids(b" ".join(part).decode())
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                raw = ids.tobytes()
                cuts = [0, *(4 * ends).tolist()]
                self.known.update(zip(part, (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
            else:
                self.known.update((w, self._plain(w.decode())) for w in part)

    def _learn(self, words: set[bytes]) -> None:
        known, pairs, letters = self.known, [], set()
        for w in words:
            core = w.rstrip(TAIL)
            if core.isascii():
                core = core.lower() if core.isalpha() else b""
            elif not core.decode().isalpha():
                core = b""
            if core:
                pairs.append((w, core, w[len(core) :]))
                letters.add(core)
            else:
                known[w] = self._plain(w.decode())
        self._letters([w for w in letters if w not in known])
        for w, core, tail in pairs:
            if tail and tail not in known:
                known[tail] = self._plain(tail.decode())
            known[w] = known[core] + known[tail] if tail else known[core]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.known is None:
            return [self._plain(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = []
        for lo in range(0, len(texts), 50):
            words = [t.encode("utf-8", "replace").split() for t in texts[lo : lo + 50]]
            self._learn(set().union(*words).difference(self.known))
            out += [b"".join(map(self.known.__getitem__, w)) for w in words]
        return out


class ByteTokenIds(TokenIds):
    """The same for a byte-level vocabulary, whose tokens carry the space before a word.

    Its pattern never joins what stands before a single space or line feed between visible characters
    with what follows, so a text's ids are those of its words, each with the separator before it.  A
    text with any other white space, or with a special token's string, is encoded whole.
    """

    def __init__(self, tokenizer) -> None:
        super().__init__(tokenizer)
        self.known, self.cores, self.tails = {}, {}, {}
        self.feed = self._ids("\n")[-1]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.starts = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.starts[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True

    def _odd(self, word: str) -> bool:
        """Words that may not be looked up alone: blank ones, with white space inside, or special."""
        core = word[1:] if word.startswith("\n") else word
        ends = core[:1] + core[-1:]
        return not core or not all(c.isalnum() or "!" <= c <= "~" for c in ends) or any(map(str.isspace, core)) or any(t in word for t in self.special)

    def _letters(self, words: list[str], separator: str) -> None:
        """Remembers words of letters only, each after ``separator``, which begins their ids."""
        for lo in range(0, len(words), JOINED):
            part = [separator + w for w in words[lo : lo + JOINED]]
            ids = self._ids("".join(part))
            at = np.flatnonzero(self.starts[ids] if separator == " " else ids == self.feed)
            if len(at) == len(part):
                raw, cuts = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                self.cores.update(zip(part, (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
            else:
                self.cores.update((w, self._plain(w)) for w in part)

    def _learn(self, words: set[str]) -> None:
        known, cores, tails, pairs, letters = self.known, self.cores, self.tails, [], {" ": set(), "\n": set()}
        for w in words:
            core = w.rstrip(PUNCTUATION)
            bare, separator = (core[1:], "\n") if core.startswith("\n") else (core, " ")
            if bare.isalpha():
                tail = w[len(core) :]
                if tail not in tails:
                    tails[tail] = self._plain(tail)
                pairs.append((w, separator + bare, tail))
                letters[separator].add(bare)
            elif self._odd(w):
                known[w] = None
            else:
                known[w] = self._plain(w if w.startswith("\n") else " " + w)
        for separator, found in letters.items():
            self._letters([w for w in found if separator + w not in cores], separator)
        for w, core, tail in pairs:
            known[w] = cores[core] + tails[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), 50):
            for memory in (self.known, self.cores, self.tails):
                if len(memory) > REMEMBERED:
                    memory.clear()
            words = [t.replace("\n", " \n").split(" ") for t in texts[lo : lo + 50]]
            self._learn(set().union(*(w[1:] for w in words)).difference(self.known))
            for t, (first, *rest) in zip(texts[lo : lo + 50], words, strict=True):
                ids = list(map(self.known.__getitem__, rest))
                out.append(self._plain(t) if self._odd(first) or None in ids else self._plain(first) + b"".join(ids))
        return out


@cache
def token_ids(path: str) -> TokenIds:
    """One for each Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    # the default pattern without a space before the text; any other settings encode whole texts
    plain = repr(tokenizer.pre_tokenizer) == repr(pre_tokenizers.ByteLevel(add_prefix_space=False))
    return (ByteTokenIds if plain else TokenIds)(tokenizer)
