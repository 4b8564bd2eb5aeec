"""Token ids of whole texts, from a public tokenizer's file, with a bounded memory of words seen before.

Both tokenizers used here split a text into runs of letters, digits and marks before they look at anything, and never let a token cross
from a visible character into the white space after it. So a text is cut before every single space that follows a visible
character, and a word of letters and plain marks is cut between the two. Runs of letters repeat, so each is encoded
once by the library, many at a time, and looked up afterwards; a word of any other shape is encoded by itself. Whether a letter
outside ASCII ends where a mark begins is asked of the library, once a letter: a capital whose lower case ends in a combining mark
takes the mark behind it along. Texts where the
cuts could matter (runs of white space, unusual white space before a space, a leading space) go to the library whole.
"""

from __future__ import annotations

import gc
import re
from collections import Counter

#: Words that a worker remembers; all are forgotten when there are more.
REMEMBERED = 1_000_000
#: White space, in the widest sense, before a space.
UNSAFE = re.compile("^ |[\\s\\x1c-\\x1f\\x85] ")
#: Marks that never join letters; letters and such marks, then a line break and more of them.
MARKS = ".,;:!?$%&#*"
LINES = re.compile(rf"([^\W\d_]+)([{re.escape(MARKS)}]*)(\n)([^\W\d_]+)([{re.escape(MARKS)}]*)")
#: Runs of letters that go to the library in one text.
TOGETHER = 256
_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One for each worker process and tokenizer."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Known(dict):
    """Ids by word; words asked for in vain are listed, in order, and read as None."""

    wanted: list[str] = []

    def __missing__(self, word: str) -> None:
        self.wanted.append(word)


class Encoder:
    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.begins, self.ends = np.array([t.startswith("Ġ") for t in tokens]), np.array([t.endswith("</w>") for t in tokens])
        self.spaced = Known()  # what stands after a space
        self.line = self.tokenizer.token_to_id("Ċ")
        self.bare: dict[str, bytes] = {}  # what doesn't
        self.parted: dict[str, bool] = {}  # letters, by whether what follows them is a word of its own

    def _ids(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, run: str) -> bool:
        """Whether run is letters only, none of which the library joins with a mark beside it."""
        if not run.isalpha():
            return False
        if run.isascii():
            return True
        parted = self.parted
        for c in set(run).difference(parted):
            whole, one, mark = self._ids([f"x{c}.", f"x{c}", "."])
            parted[c] = c.isascii() or whole == one + mark
        return all(map(parted.__getitem__, set(run)))

    def _runs(self, runs: list[str], lead: str) -> list[bytes]:
        """Ids of runs of letters, each after lead (a space or nothing)."""
        import numpy as np

        out: list[bytes] = []
        groups = [runs[i : i + TOGETHER] for i in range(0, len(runs), TOGETHER)]
        for part, found in zip(groups, self._ids([lead + (lead or "\n").join(part) for part in groups])):
            ids, skip = np.frombuffer(found, "<u4"), 0
            if self.ends.any():
                cuts = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
            elif lead:
                cuts = np.append(np.flatnonzero(self.begins[ids]), len(ids))
            else:
                cuts, skip = np.append(np.append(-1, np.flatnonzero(ids == self.line)) + 1, len(ids) + 1), 4
            if len(cuts) == len(part) + 1:
                at = (4 * cuts).tolist()
                out += [found[a : b - skip] for a, b in zip(at, at[1:])]
            else:  # a run that the library cuts in another way
                out += self._ids([lead + x for x in part])
        return out

    def _learn(self, known: dict[str, bytes], words: set[str], lead: str) -> None:
        new = [x for x in words if x not in known]
        letters, other = [], []
        for x in new:
            (letters if x.isalpha() else other).append(x)
        known.update(zip(letters, self._runs(letters, lead)))
        known.update(zip(other, self._ids([lead + x for x in other])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers."""
        # Millions of small objects come and go here without a cycle among them, so the collector would only cost.
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        spaced, bare = self.spaced, self.bare
        for known in (spaced, bare):
            if len(known) > REMEMBERED:
                known.clear()
        spaced.wanted = []
        cut = [t.split(" ") for t in texts]
        firsts = [p[0] for p in cut]
        found = [list(map(spaced.__getitem__, p[1:])) for p in cut]
        del cut
        # A word that isn't known comes apart into runs, which are remembered; it is itself made for this call only.
        missing, runs, heads, shapes = set(spaced.wanted), set(), set(firsts), {}
        for word in missing:
            letters = word.rstrip(MARKS)
            if self._letters(letters):
                runs.add(letters)
                if len(letters) < len(word):
                    shapes[word] = (letters, (marks := word[len(letters) :],))
                    heads.add(marks)
            elif (m := LINES.fullmatch(word)) and self._letters(m[1]) and self._letters(m[4]):
                runs.add(m[1])
                shapes[word] = (m[1], rest := tuple(x for x in m.groups()[1:] if x))
                heads.update(rest)
            else:
                runs.add(word)
        self._learn(bare, heads, "")
        self._learn(spaced, runs, " ")
        made = {w: spaced[a] + b"".join([bare[x] for x in rest]) for w, (a, rest) in shapes.items()}
        fill = iter([made[w] if w in made else spaced[w] for w in spaced.wanted])
        out = [bare[first] + b"".join([next(fill) if x is None else x for x in own]) for first, own in zip(firsts, found)]
        odd = {w for w in missing if not w or w[-1].isspace() or w[-1] in "\x1c\x1d\x1e\x1f\x85"}
        if odd or "" in heads:
            whole = [i for i, t in enumerate(texts) if not t or UNSAFE.search(t)]
            for i, ids in zip(whole, self._ids([texts[i] for i in whole])):
                out[i] = ids
        for word, n in Counter(spaced.wanted).items():
            if n > 1 and word in made:
                spaced[word] = made[word]  # common enough to be remembered as it is
        for word in odd:
            spaced.pop(word, None)  # so that it is noticed again
        return out


def in_chunks(texts: list[str], chars: int = 1_000_000):
    """Slices of the texts of about so many characters, so that a batch of long ones takes little memory."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
