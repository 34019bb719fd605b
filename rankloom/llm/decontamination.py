"""Operator 10, benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: numbers, units and names turn into typed placeholders whose values are kept as slots, other
words are lower-cased. Windows of template tokens are hash-joined with the windows of the benchmark; matches of one item that lie on one
diagonal, or on neighbouring ones in order, are put together, and their slots must agree with the item's by a one-to-one renaming. A question that was copied with other
numbers or names is caught; a text that only shares a pattern of placeholders is not. Each text has a second template in which names
stay words: so a copy in other letter case is caught as well. In a third one, capitalised words that begin a sentence are names too.

Workers first hash a batch's windows in array operations; only documents with a window of the benchmark are looked at closely.

The benchmark is the join's small side. It is sent to the workers in blocks of BLOCK_WINDOWS windows, each of proven size; a larger
benchmark takes more passes over the documents, and loses nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import table

#: Template tokens in a window; share of an item's windows that a document must hold; or so many tokens on end.
WINDOW, CONTAINED, RUN = 5, 0.8, 13
#: Diagonals of an item that lie so near are one copy with words put in or left out; items from JOINED tokens on are joined so.
SHIFT, JOINED = 4, 2 * WINDOW
#: Share of an item's matched tokens that may be renamed slots, at most: more would match on placeholders alone.
MAX_RENAMED = 0.4
#: Windows of the benchmark that a block may have (about 60 bytes each, with their text, in every worker and on the driver).
BLOCK_WINDOWS = 1_000_000

UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles g kg mg lb lbs oz ton tons t l ml litre litres liter liters gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros pound pounds cent cents percent % $ € £ ° c f degree degrees kwh w kw v a hz mph kmh".split()
)
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
#: Templates: names inside sentences (True), no names (False), and names at the beginnings of sentences too.
EVERY = 2
TEMPLATES = (True, False, EVERY)

_TOKEN = re.compile(r"[0-9]+(?:[.,:/][0-9]+)*|[^\W\d_]+(?:['’-][^\W\d_]+)*|[%$€£°]|[.!?]")


def _kind(token: str) -> int:
    """0 word, 1 number, 2 word or sign that is a unit beside a number, 3 word that is a name inside a sentence, 4 end of a sentence."""
    if token[0] in ".!?":
        return 4
    if token[0].isdigit():
        return 1
    if token.lower() in UNITS:
        return 2
    return 3 if token[0].isupper() and len(token) > 1 and token[1:].islower() else 0


def template(text: str | None, names: int = True) -> tuple[list[str], list[str]]:
    """Template tokens and, for each, its value: '' for plain words.

    Numbers are digits with inner separators. A unit is a word or sign of UNITS beside a number. With `names`, a capitalised word that
    does not begin a sentence or line is a name; with EVERY, one that does as well. Other words are taken as they are, in lower case; punctuation goes.
    """
    words: list[tuple[str, int, bool]] = []
    for line in (text or "").split("\n"):
        begins = True
        for w in _TOKEN.findall(line):
            kind = _kind(w)
            if kind != 4:
                words.append((w, kind, begins))
            begins = kind == 4
    tokens: list[str] = []
    values: list[str] = []
    for k, (w, kind, begins) in enumerate(words):
        low = w.lower()
        beside = k and words[k - 1][1] == 1 or k + 1 < len(words) and words[k + 1][1] == 1
        token = NUMBER if kind == 1 else UNIT if kind == 2 and beside else NAME if kind == 3 and names and (names == EVERY or not begins) else low
        tokens.append(token)
        values.append(low if token in (NUMBER, UNIT, NAME) else "")
    return tokens, values


class _Characters:
    """What the characters are, as tables over code points that are filled for each block of 256 when it is first met; and hashes of spans.

    kind: bits LETTER ... NUMBER_JOIN, after the classes of _TOKEN; case: 1 upper, 2 lower, 4 title, 8 a digit in another form; lower: the character in
    lower case, if that is one character, with one form of sigma.
    """

    LETTER, DIGIT, SIGN, END, WORD_JOIN, NUMBER_JOIN = 1, 2, 4, 8, 16, 32
    BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def __init__(self):
        import numpy as np

        self.kind, self.case = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
        self.lower, self.met = np.arange(0x110000, dtype=np.uint32), np.zeros(0x1100, bool)
        self.up = self.down = np.zeros(0, np.uint64)
        self.letter = re.compile(r"[^\W\d_]").match

    def codes(self, text: str):
        import numpy as np

        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        blocks = np.flatnonzero(np.bincount(codes >> 8, minlength=0x1100))
        for block in blocks[~self.met[blocks]].tolist():
            for c in range(256 * block, 256 * block + 256):
                ch = chr(c)
                kind = self.LETTER if self.letter(ch) else self.DIGIT if ch in "0123456789" else self.SIGN if ch in "%$€£°" else 0
                self.kind[c] = kind | (self.END if ch in ".!?" else 0) | (self.WORD_JOIN if ch in "'’-" else 0) | (self.NUMBER_JOIN if ch in ".,:/" else 0)
                self.case[c] = 1 if ch.isupper() else 2 if ch.islower() else 4 if ch.istitle() else 8 if ch.isdigit() else 0
                self.lower[c] = ord("σ") if ch in "Σς" else ord(ch.lower()) if len(ch.lower()) == 1 else c
            self.met[block] = True
        return codes

    def hashes(self, codes, first, last):
        """A hash of each span of characters in lower case: a polynomial in BASE, from sums over the whole text."""
        import numpy as np

        if len(self.up) < len(codes):
            n = max(len(codes), 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (self.BASE, self.INVERSE))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((self.lower[codes].astype(np.uint64) + np.uint64(1)) * self.up[: len(codes)], out=sums[1:])
        h = (sums[last] - sums[first]) * self.down[first]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


_CHARACTERS: list[_Characters] = []


def _characters() -> _Characters:
    """One per worker process."""
    if not _CHARACTERS:
        _CHARACTERS.append(_Characters())
    return _CHARACTERS[0]


def token_hashes(tokens: list[str]):
    import numpy as np

    if not tokens:
        return np.zeros(0, np.uint64)
    made = _characters()
    codes = made.codes("\n".join(tokens))
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    last = np.cumsum(n + 1) - 1
    return made.hashes(codes, last - n, last)


def _rolled(a, width: int):
    """Hashes of all windows of `width` in an array of token hashes."""
    import numpy as np

    out = np.full(len(a) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ a[k : len(a) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def window_hashes(tokens: list[str]):
    """Hashes of a template's windows; a shorter template is one window, which only a text of that length equals."""
    a = token_hashes(tokens)
    return _rolled(a, min(WINDOW, len(a))) if len(a) else a


class Index:
    """The windows of a block of benchmark items, for all templates: where each hash occurs, and a bitmap for quick refusal.

    Places are arrays of 17 bytes a window and template. An item's templates are made again when it is met, and the last ones kept.
    """

    BITS, KEPT = 22, 4096

    def __init__(self, items: list[tuple]):
        import numpy as np

        self.texts, self.kept = items, {}
        hashes, item, names, pos = [], [], [], []
        for k, (_, text) in enumerate(items):
            for t in TEMPLATES:
                h = window_hashes(template(text, t)[0])
                hashes.append(h)
                item.append(np.full(len(h), k, np.int32))
                names.append(np.full(len(h), t, np.uint8))
                pos.append(np.arange(len(h), dtype=np.int32))
        joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        every = joined(hashes, np.uint64)
        order = np.argsort(every, kind="stable")
        self.sorted, self.item, self.names, self.pos = every[order], joined(item, np.int32)[order], joined(names, np.uint8)[order], joined(pos, np.int32)[order]
        self.bitmap = np.zeros(1 << self.BITS, bool)
        self.bitmap[self.sorted >> np.uint64(64 - self.BITS)] = True

    def own(self, k: int, names: int) -> tuple[list[str], list[str], int]:
        """Template tokens, values and number of windows of item k."""
        found = self.kept.get((k, names))
        if found is None:
            if len(self.kept) >= self.KEPT:
                self.kept.clear()
            tokens, values = template(self.texts[k][1], names)
            found = self.kept[k, names] = tokens, values, max(1, len(tokens) - WINDOW + 1)
        return found

    def has(self, h):
        """Which of these hashes are windows of the benchmark."""
        import numpy as np

        at = np.flatnonzero(self.bitmap[h >> np.uint64(64 - self.BITS)])
        near = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        return at[self.sorted[near] == h[at]] if len(self.sorted) else at[:0]

    def matches(self, text: str | None) -> list[tuple]:
        """(item, share of its windows, longest run of tokens, renamed slots, first token in the text) of the items that a text holds."""
        import numpy as np

        best: dict[object, tuple] = {}
        near: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        texts: dict[int, tuple] = {}
        for names in TEMPLATES:
            tokens, values = template(text, names)
            # windows on one diagonal (text position minus item position) belong to one copy
            diagonals: dict[tuple, list[int]] = defaultdict(list)
            h = window_hashes(tokens)
            held = self.has(h)
            for pos, a, b in zip(held.tolist(), np.searchsorted(self.sorted, h[held]).tolist(), np.searchsorted(self.sorted, h[held], side="right").tolist()):
                for own, n, k in zip(self.item[a:b].tolist(), self.names[a:b].tolist(), self.pos[a:b].tolist()):
                    if n == names:
                        diagonals[own, pos - k].append(k)
            for (own, shift), ks in diagonals.items():
                item = self.texts[own][0]
                found = self._verified((own, names), shift, ks, tokens, values)
                if found and (found[0] >= CONTAINED or found[1] >= RUN) and found[:2] > best.get(item, (0, 0))[:2]:
                    best[item] = found
            for (own, shift), ks in diagonals.items():
                near[own, names].extend((shift, k) for k in ks)
            texts[names] = tokens, values
        # the template with most slots comes first: what disagrees there is no copy in another
        wrong = set()
        for names in (EVERY, True, False):
            for key, at in near.items():
                if key[1] == names and self.texts[key[0]][0] not in best and key[0] not in wrong:
                    found = self._joined(key, at, *texts[names])
                    if found:
                        best[self.texts[key[0]][0]] = found
                    elif found is False:
                        wrong.add(key[0])
        return sorted(((i, *x) for i, x in best.items()), key=lambda x: (-x[1], -x[2], x[0] is None, x[0]))

    def _verified(self, key: tuple, shift: int, ks: list[int], tokens: list[str], values: list[str]):
        """What is left of a diagonal's matches when the slots must agree by a one-to-one renaming; None if nothing is."""
        own, slots, windows = self.own(*key)
        width = min(WINDOW, len(own))
        there: dict[tuple, str] = {}
        back: dict[tuple, str] = {}
        good, run, longest, changed, covered, last = 0, 0, 0, set(), set(), None
        for k in sorted(ks):
            consistent = own[k : k + width] == tokens[k + shift : k + shift + width]
            for j in range(k, k + width) if consistent else ():
                if j in covered or not slots[j]:
                    continue
                a, b = (own[j], slots[j]), (own[j], values[j + shift])
                if there.setdefault(a, b[1]) != b[1] or back.setdefault(b, a[1]) != a[1]:
                    consistent = False
                    break
                if a != b:
                    changed.add(j)
            if not consistent:
                last = None
                continue
            good += 1
            covered.update(range(k, k + width))
            run = run + 1 if last == k - 1 else width
            longest, last = max(longest, run), k
        if not good or len(changed) > MAX_RENAMED * len(covered):
            return None
        return good / windows, longest, len(changed), shift + min(covered)

    def _joined(self, key: tuple, at: list[tuple[int, int]], tokens: list[str], values: list[str]):
        """The same as _verified() over windows (shift, place) on neighbouring diagonals: the share is that of the item's tokens which match in order.

        A changed word costs one token here, not all windows that hold it. None below CONTAINED, or if windows have less than half of the item, or if any slots disagree (False).
        """
        own, slots, _ = self.own(*key)
        n = len(own)
        if n < JOINED:
            return None
        at, best, wrong = sorted(at), None, False
        for start in sorted({shift for shift, _ in at}):
            windows = [(k, shift) for shift, k in at[bisect_left(at, (start, -1)) : bisect_left(at, (start + SHIFT + 1, -1))]]
            if 2 * WINDOW * len(windows) < n:
                continue
            found = self._chained(own, slots, sorted(windows), tokens, values)
            wrong = wrong or found is False
            if found and (best is None or found[:2] > best[:2]):
                best = found
        return best or (False if wrong else None)

    @staticmethod
    def _chained(own: list[str], slots: list[str], windows: list[tuple[int, int]], tokens: list[str], values: list[str]):
        n = len(own)
        there: dict[tuple, str] = {}
        back: dict[tuple, str] = {}
        places: dict[int, int] = {}
        changed, wrong = set(), set()

        def take(j: int, p: int) -> bool:
            """Matches the item's token j with the text's token p if template and slots agree."""
            if not 0 <= p < len(tokens) or own[j] != tokens[p]:
                return False
            if slots[j]:
                a, b = (own[j], slots[j]), (own[j], values[p])
                if there.get(a, b[1]) != b[1] or back.get(b, a[1]) != a[1]:
                    wrong.add(j)
                    return False
                there[a], back[b] = b[1], a[1]
                if a != b:
                    changed.add(j)
            places[j] = p
            return True

        last = -1
        for k, shift in windows:
            for j in range(k, k + WINDOW):
                if j not in places and j + shift > last and take(j, j + shift):
                    last = j + shift
        if 2 * len(places) < n:
            return None
        if wrong:
            return False
        # single tokens between and beside the windows, on the diagonal of the match before or after
        bound, shift, before = [len(tokens)] * n, None, -1
        for j in range(n - 1, 0, -1):
            bound[j - 1] = places.get(j, bound[j])
        for j in range(n):
            if j not in places and shift is not None and before < j + shift < bound[j]:
                take(j, j + shift)
            if j in places:
                shift, before = places[j] - j, places[j]
        bound, shift, after = [-1] * n, None, len(tokens)
        for j in range(n - 1):
            bound[j + 1] = places.get(j, bound[j])
        for j in range(n - 1, -1, -1):
            if j not in places and shift is not None and bound[j] < j + shift < after:
                take(j, j + shift)
            if j in places:
                shift, after = places[j] - j, places[j]
        if wrong or len(places) < CONTAINED * n or len(changed) > MAX_RENAMED * len(places):
            return None
        run = longest = 0
        for j in range(n):
            run = run + 1 if j in places and places.get(j - 1, places[j] - 1) == places[j] - 1 else int(j in places)
            longest = max(longest, run)
        return len(places) / n, longest, len(changed), min(places.values())


class Scanner:
    """Finds the texts of a batch that share a window with an index, in array operations over the characters of many texts at a time."""

    #: Characters that are taken at a time; a longer text is looked at closely as it is.
    STEP = 1 << 20

    def __init__(self, index: Index):
        self.index, self.made = index, _characters()
        self.fixed = dict(zip((NUMBER, UNIT, NAME), token_hashes([NUMBER, UNIT, NAME])))
        self.units = token_hashes(sorted(UNITS))

    def candidates(self, texts: list[str | None]) -> list[int]:
        """Rows whose texts have a window of the index in one of their templates; texts that no array can tell are among them."""
        out: list[int] = []
        rows: list[int] = []
        some: list[str] = []
        size = 0
        for row, text in enumerate(texts):
            # a dotted capital I is two characters in lower case
            pieces = None if text and "\u0130" in text else self._pieces(text or "")
            if pieces is None:
                out.append(row)
                continue
            for piece in pieces:
                rows.append(row)
                some.append(piece)
                size += len(piece) + 1
                if size >= self.STEP:
                    out += self._hits(rows, some)
                    rows, some, size = [], [], 0
        return sorted({*out, *self._hits(rows, some)})

    def _pieces(self, text: str) -> list[str] | None:
        """The text in pieces of STEP characters at most, cut at white space, each with the last tokens of the one before: every window
        is whole in one of them, with the tokens beside it. None if it has no white space to cut at."""
        out, at = [], 0
        while len(text) - at > self.STEP:
            space = lambda a, b: max(text.rfind(" ", a, b), text.rfind("\n", a, b))
            cut = space(at + self.STEP // 2, at + self.STEP)
            back, width = cut, 256
            while cut >= 0 and len(_TOKEN.findall(text, back, cut)) < 3 * WINDOW:
                back, width = space(at + 1, cut - width), 2 * width
                if back < 0:
                    return None
            if cut < 0:
                return None
            out.append(text[at:cut])
            at = back
        return [*out, text[at:]]

    def _tokens(self, text: str):
        """(first character, hash, kind, whether it begins a sentence) of the tokens of a text, as template() has them."""
        import numpy as np

        made = self.made
        codes = made.codes(text)
        k = np.concatenate([np.zeros(1, np.uint8), made.kind[codes], np.zeros(1, np.uint8)])
        here, before, after = k[1:-1], k[:-2], k[2:]
        word = (here & made.LETTER > 0) | (here & made.WORD_JOIN > 0) & (before & made.LETTER > 0) & (after & made.LETTER > 0)
        number = (here & made.DIGIT > 0) | (here & made.NUMBER_JOIN > 0) & (before & made.DIGIT > 0) & (after & made.DIGIT > 0)
        t = np.where(word, 1, np.where(number, 2, np.where(here & made.SIGN > 0, 3, np.where(here & made.END > 0, 4, 0)))).astype(np.int8)
        edge = np.concatenate([np.zeros(1, np.int8), t, np.zeros(1, np.int8)])
        first = np.flatnonzero((t > 0) & ((t != edge[:-2]) | (t > 2)))
        last = np.flatnonzero((t > 0) & ((t != edge[2:]) | (t > 2))) + 1
        t = t[first]
        h = made.hashes(codes, first, last)
        case = made.case[codes]
        lower, other = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (case == 2, (case & 5) > 0))
        name = (t == 1) & (case[first] == 1) & (other[last] == other[first] + 1) & (lower[last] > lower[first])
        kind = np.where(t == 4, 4, np.where((t == 2) | (case[first] == 8), 1, np.where(np.isin(h, self.units), 2, np.where(name, 3, 0)))).astype(np.int8)
        lines = np.cumsum(codes == 10, dtype=np.int32)[first] if len(first) else first
        begins = np.ones(len(first), bool)
        begins[1:] = (lines[1:] != lines[:-1]) | (kind[:-1] == 4)
        return first, h, kind, begins

    def _templates(self, h, kind, begins, text):
        """The hashes of the tokens of each of TEMPLATES; text: the number of each token's text."""
        import numpy as np

        number = np.concatenate(([False], kind == 1, [False]))
        same = np.concatenate(([False], text[1:] == text[:-1], [False]))
        unit = (kind == 2) & (number[:-2] & same[:-1] | number[2:] & same[1:])
        plain = np.where(kind == 1, self.fixed[NUMBER], np.where(unit, self.fixed[UNIT], h))
        return np.where((kind == 3) & ~begins, self.fixed[NAME], plain), plain, np.where(kind == 3, self.fixed[NAME], plain)

    def _hits(self, rows: list[int], some: list[str]) -> list[int]:
        import numpy as np

        if not rows:
            return []
        first, h, kind, begins = self._tokens("\n".join(some))
        end = np.cumsum(np.fromiter((len(t) + 1 for t in some), np.int64, len(some)))
        bound = np.searchsorted(first, end)
        word = kind != 4
        # ends of sentences go; a text's bound becomes the number of words before it
        bound = np.concatenate(([0], np.cumsum(word)))[bound]
        h, kind, begins = h[word], kind[word], begins[word]
        if not len(h):
            return []
        text = np.searchsorted(bound, np.arange(len(h)), side="right")
        found = set()
        for a in self._templates(h, kind, begins, text):
            if len(a) >= WINDOW:
                hit = self.index.has(_rolled(a, WINDOW))
                found.update(text[hit[text[hit] == text[hit + WINDOW - 1]]].tolist())
        # texts shorter than a window are one window
        length = np.diff(np.concatenate(([0], bound)))
        found.update(np.flatnonzero((length > 0) & (length < WINDOW)).tolist())
        return [rows[k] for k in sorted(found)]


def blocks(benchmark: DataFrame, limit: int = BLOCK_WINDOWS) -> Iterator[list[tuple]]:
    """The benchmark's items, in blocks of `limit` windows at most (a longer item is a block of its own), read one partition at a time."""
    block, windows = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(_TOKEN.findall(r["text"])) + 1
        if block and windows + n > limit:
            yield block
            block, windows = [], 0
        block.append((r["item_id"], r["text"]))
        windows += n
    if block:
        yield block


def _found(docs: DataFrame, index, columns: str, kind) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(kind)

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scan = Scanner(index.value)
        for batch in batches:
            ids, texts = batch.columns
            texts = texts.to_pylist()
            rows = [(i, *m) for i in scan.candidates(texts) for m in scan.index.matches(texts[i])]
            at, item, share, run, renamed, start = zip(*rows) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(item, item_type), pa.array(share, pa.float64()), pa.array(run, pa.int32()), pa.array(renamed, pa.int32()), pa.array(start, pa.int32())],
                ["doc_id", "item_id", "contained", "run", "renamed", "start"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(found, columns)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, item_id, contained, run, renamed, start: a row for each document and each benchmark item that it holds.

    A document holds an item if, on one diagonal, at least CONTAINED of the item's windows match, or a run of RUN tokens does, with slots
    that agree by a one-to-one renaming of at most MAX_RENAMED of the tokens. So does one that holds CONTAINED of the tokens of an item of
    JOINED tokens or more, in order, on diagonals at most SHIFT apart, with half of the item in matching windows and no slots that disagree. contained: that share; run: tokens in the longest run;
    renamed: slots with another value; start: the match's first token in the document. An item of fewer tokens than a window is held only by
    a document that is that item, as short ones would be found in clean texts.
    Null and empty texts and items match nothing. Repeated documents are rows of their own; repeated items count once. An empty table
    gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType
    columns = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {kind.simpleString()}, contained double, run int, renamed int, start int"
    out = spark.createDataFrame([], columns)
    for block in blocks(benchmark, limit):
        out = out.union(_found(docs, spark.sparkContext.broadcast(Index(block)), columns, kind))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item. Rows are filtered where they are: nothing is shuffled.

    Null and empty texts hold nothing and stay, repeated rows stay or go together, an empty table stays empty, an empty benchmark drops nothing.
    """
    at = docs.columns.index("text")

    def clean(index):
        def kept(batches: Iterator) -> Iterator:
            import pyarrow as pa

            scan = Scanner(index.value)
            for batch in batches:
                texts = batch.column(at).to_pylist()
                held = {i for i in scan.candidates(texts) if scan.index.matches(texts[i])}
                yield batch.filter(pa.array([i not in held for i in range(len(texts))], pa.bool_()))

        return kept

    for block in blocks(benchmark, limit):
        docs = docs.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(Index(block))), docs.schema)
    return docs


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
