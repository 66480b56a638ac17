"""Repair of text read from scanned pages, and the kinds of noise found in it."""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.arrow import column, map_batches, strings
from brindle.plans.physical import cut_lineage, spread

LEAST_COUNT, LEAST_SHARE = 3, 1e-6  # a lexicon has a million words at most, whatever the corpus
HEAD = 4
LONGEST = 40  # characters of a word of the lexicon
FLUSH = 400_000
RATIO = 20.0  # how many times more frequent the right word must be
HYPHENS = "-‐‑­¬"

# What readers of printed pages often take for what, (read, meant): a starting list of our own, to which ``learn_confusions`` adds.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("8", "b"), ("9", "g"), ("6", "b"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"),
    ("b", "h"), ("h", "b"), ("l", "i"), ("i", "l"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"),
    ("vv", "w"), ("w", "vv"), ("h", "li"), ("li", "h"), ("n", "u"), ("u", "n"), ("o", "0"), ("ri", "n"), ("ni", "m"),
]

_CORE = re.compile(r"^[^\w]*([\w](?:.*[\w])?)[^\w]*$", re.S)
_CODE = re.compile(r"^[A-Z]\d|^\d[\d.,:/%]*$|^\d+[A-Za-zÀ-ÿ]{0,3}$|\d-\d|^[A-Z]\d?-|^\W*$")
_NUMBER = re.compile(
    r"^[\[(\-–—\s]*(?:(?:p|page|pages|pg|seite|s|página|pagina|pág|hal|стр|صفحة|पृष्ठ|หน้า|ページ|第)\s*\.?\s*)?[\[(\-–—\s]*(\d{1,4}|[ivxl]{1,7})\s*(?:(?:/|of|von|de|sur)\s*\d{1,4})?\s*(?:页|頁|ページ)?[\])\-–—\s]*$", re.I
)
_BESIDE = re.compile(r"^\s*(?:(\d{1,4})\s{2,}(\S.*?)|(\S.*?)\s{2,}(\d{1,4}))\s*$")
_NO_TITLE = re.compile(r"^(?:[•▪◦*+·|-]|\[.?\])|[,;!?|\t]|[^\d\s]\.\s")
_TERMINAL = re.compile(r"[.!?。！？।؟…:;][\"”“’»)\]」』]*(?:\s»)?\s*$")
# Scripts that don't part words by spaces: Han, kana, Thai, Lao, Khmer, Myanmar.
_TIGHT = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_TIGHT_AT = re.compile(f"[{_TIGHT}]")
_TIGHT_PAIRS = re.compile(f"(?=([{_TIGHT}][ \n]?[{_TIGHT}]))")
_LETTERS = re.compile(r"[^\W\d_]+")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50}


def core(token: str) -> str:
    m = _CORE.match(token)
    return m.group(1) if m else ""


# -- lexicon and confusions -------------------------------------------------------------------------


def lexicon(df: DataFrame, text: str = "text") -> dict[str, int]:
    """Counts of the lower-cased words of all texts that make up a millionth of all words (and occur three times).

    Words at a line end with a hyphen, and those after one, are left out: they may be parts. Of scripts
    without spaces it has pairs of characters, side by side (``"\\x02ab"``) and with a space between
    (``"\\x02a b"``). Counted in each task first; the words kept are a million at most, so they can be sent
    to every task.
    """
    texts = spread(df.select(df[text].alias("t")).where("t is not null"), "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for x, n in own.items():
                if 0 < len(w := x.strip(".,;:!?\"'“”„«»()[]।؟،؛¿¡…—").lower()) <= LONGEST:
                    words[w] += n
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["w", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                own.update(_whole_tokens(t))
                if _TIGHT_AT.search(t):
                    own.update("\x02" + x for x in _TIGHT_PAIRS.findall(t) if "\n" not in x)
            if len(own) > FLUSH:
                yield out()
                own.clear()
        if own:
            yield out()

    counts = cut_lineage(texts.mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))  # read twice, counted once
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.where((F.col("n") >= LEAST_COUNT) & (F.col("n") >= LEAST_SHARE * total))
    return {r.w: r.n for r in kept.toLocalIterator()}


_BROKEN = re.compile(r"\S*[-‐‑­¬][^\S\n]*\n\s*\S+")


_LINE_HYPHEN = re.compile(r"[-‐‑­¬][^\S\n]*\n")


def _whole_tokens(t: str) -> list[str]:
    return (_BROKEN.sub(" ", t) if "\n" in t and _LINE_HYPHEN.search(t) else t).split()


def _differences(noisy: str, clean: str) -> Iterator[tuple[str, str]]:
    """(read, meant): one or two letters for one or two, for each word that a noisy text has otherwise than its proofread one."""
    a, b = noisy.split(), clean.split()
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "replace" and i2 - i1 == j2 - j1:
            for x, y in zip(a[i1:i2], b[j1:j2]):
                x, y = core(x).lower(), core(y).lower()
                k = 0
                while k < min(len(x), len(y)) and x[k] == y[k]:
                    k += 1
                e = 0
                while e < min(len(x), len(y)) - k and x[-1 - e] == y[-1 - e]:
                    e += 1
                read, meant = x[k : len(x) - e], y[k : len(y) - e]
                if 1 <= len(read) <= 2 and 1 <= len(meant) <= 2:
                    yield read, meant


def learn_confusions(pages: DataFrame) -> list[tuple[str, str]]:
    """(read, meant) pairs of one or two letters met twice in all ``pages`` (text, clean_text), besides the fixed ones.

    Compared and counted where the pages lie; only the pairs, which are letters and not texts, reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for noisy, clean in zip(strings(batch, "text"), strings(batch, "clean_text")):
                seen.update(_differences(noisy, clean))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in seen], pa.string()), pa.array([m for _, m in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["read", "meant", "n"])

    both = pages.select("text", "clean_text").where("text is not null and clean_text is not null")
    counts = both.mapInArrow(count, "read string, meant string, n long").groupBy("read", "meant").agg(F.sum("n").alias("n")).where("n >= 2")
    return sorted((r.read, r.meant) for r in counts.toLocalIterator())


class _Plain(dict):
    """Token -> whether it is known and right as it stands."""

    def __init__(self, reader: "Reader"):
        super().__init__()
        self.reader = reader

    def __missing__(self, token: str) -> bool:
        c = core(token)
        if len(self) > 300_000:
            self.clear()
        self[token] = ok = not c or _CODE.search(c) is not None or (c.lower() in self.reader.counts and self.reader.meant(c) is None)
        return ok


class _Price(dict):
    """Token -> cost as it stands."""

    def __init__(self, reader: "Reader"):
        super().__init__()
        self.reader = reader

    def __missing__(self, token: str) -> float:
        c = core(token)
        if len(self) > 300_000:
            self.clear()
        self[token] = p = self.reader.cost(c.lower()) if c else 1.0
        return p


class Reader:
    """Lexicon and confusions, with what has been looked up so far."""

    def __init__(self, counts: dict[str, int], confusions: list[tuple[str, str]]):
        self.counts = counts
        self.total = max(1, sum(counts.values()))
        self.by_first: dict[str, list[tuple[str, str]]] = {}
        for read, meant in dict.fromkeys([*CONFUSIONS, *confusions]):
            self.by_first.setdefault(read[0], []).append((read, meant))
        self.heads, self.tails = {w[:HEAD] for w in counts}, {w[-HEAD:] for w in counts}
        self.known: dict[str, str | None] = {}
        self.plain, self.price = _Plain(self), _Price(self)

    def noted(self, tokens: list[str], text: str) -> bool:
        """Whether anything in a text asks for decoding: an unknown word, a hyphen at a line end, or broken lines."""
        return "\n" in text or not all(map(self.plain.__getitem__, tokens))

    def cost(self, word: str) -> float:
        """Negative log probability of a word; of an unknown one, more with its length."""
        n = self.counts.get(word, 0)
        return math.log(self.total / n) if n else math.log(self.total) + 2.0 + 0.3 * len(word)

    def meant(self, token: str) -> str | None:
        """The lower-cased word a token was misread from; None where it is right, or nothing better is known."""
        if token in self.known:
            return self.known[token]
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[token] = found = self._search(token)
        return found

    def _search(self, token: str) -> str | None:
        """The likeliest word one confusion away, or two for an unknown word."""
        w = token.lower()
        if len(w) < 3 or len(w) > LONGEST + 2 or _CODE.search(token) or not any(c.isalpha() for c in w):
            return None  # a confusion adds or takes a character at most, and no word is longer than LONGEST
        own = self.counts.get(w, 0)
        best, count = None, max(own, 0.2) * RATIO
        for v in self._variants(w, 1 if own else 2):
            n = self.counts.get(v, 0)
            if v != w and (n > count or n == count and best is not None and v < best):
                best, count = v, n
        return best

    def _variants(self, w: str, edits: int) -> Iterator[str]:
        """Words one edit away and, if two are allowed, two edits at different places; those whose first or last characters begin or end no word are left out early."""
        places = [(i, i + len(read), meant) for i, c in enumerate(w) for read, meant in self.by_first.get(c, ()) if w.startswith(read, i)]
        size = len(w)
        heads, tails = w[:HEAD] in self.heads, w[-HEAD:] in self.tails
        for k, (i, e, m) in enumerate(places):
            start, near = w[:i] + m, heads or i < HEAD
            if not near:
                break  # places are in order: from here on the head stays as it is
            if tails or e > size - HEAD:
                yield start + w[e:]
            if edits > 1:
                fixed = len(start) >= HEAD and start[:HEAD] not in self.heads
                for i2, e2, m2 in places[k + 1 :]:
                    if i2 >= e and not fixed and (tails or e2 > size - HEAD):
                        middle = start + w[e:i2]
                        if len(middle) >= HEAD and middle[:HEAD] not in self.heads:
                            break  # what follows only changes characters further on
                        yield middle + m2 + w[e2:]

    def joins(self, left: str, right: str) -> bool:
        """Whether a hyphen at a line end doesn't belong to the word: joined must be the likelier word."""
        a, b = core(left.rstrip(HYPHENS)), core(right)
        if not a or not b or not b[0].islower() or any(c.isdigit() for c in a) and _CODE.search(a) or len(a) < 2:
            return False
        a, b = a.lower(), b.lower()
        soft = left[-1] not in "-‑"
        whole, kept = self.counts.get(a + b, 0), self.counts.get(f"{a}-{b}", 0)
        if whole or kept:
            return whole > kept
        if fixed := (self._search(a + b) if len(a + b) > 4 else None):
            return self.counts[fixed] > self.counts.get(f"{a}-{b}", 0)
        if soft:
            return True
        return not (self.counts.get(a, 0) > 30 and self.counts.get(b, 0) > 30)


# -- page furniture ----------------------------------------------------------------------------------


def _value(s: str) -> int:
    s = s.lower()
    if s.isdigit():
        return int(s)
    v = [_ROMAN[c] for c in s]
    return sum(-a if i + 1 < len(v) and a < v[i + 1] else a for i, a in enumerate(v))


def _fold(s: str) -> str:
    s = re.sub(r"\s+", " ", s.strip().lower())
    for a, b in (("0", "o"), ("1", "l"), ("i", "l"), ("5", "s"), ("8", "b"), ("9", "g"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("f", "t"), ("h", "b"), ("c", "e")):
        s = s.replace(a, b)
    return s


def _sequence(found: list[tuple[int, int]]) -> list[int]:
    """Line numbers of the longest run of numbers that grow from page to page (by one, or by two where a page's was lost)."""
    length, before, last = [1] * len(found), [-1] * len(found), {}
    for i, (line, value) in enumerate(found):
        for v in (value - 1, value - 2):
            for j in last.get(v, ()):
                if line - found[j][0] >= 3 and length[j] + 1 > length[i]:
                    length[i], before[i] = length[j] + 1, j
        ends = last.setdefault(value, [])
        ends.append(i)
        ends.sort(key=lambda j: (-length[j], -found[j][0]))
        del ends[4:]  # the longest runs to this number; a later end of a shorter run can't do more than they
    best = max(range(len(found)), key=length.__getitem__, default=-1)
    if best < 0 or length[best] < 2:
        return []
    out = []
    while best >= 0:
        out.append(found[best][0])
        best = before[best]
    return out[::-1]


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 2 or n < 8:
        return False
    if n == m and sum(x != y for x, y in zip(a, b)) <= 2:
        return True
    k = 0
    while k < min(n, m) and a[k] == b[k]:
        k += 1
    e = 0
    while e < min(n, m) - k and a[-1 - e] == b[-1 - e]:
        e += 1
    return k + e >= max(n, m) - 3


def _title_keys(f: str) -> list[tuple]:
    """Keys of which any two alike lines share one: a half where they differ in one place, a third where in two."""
    n = len(f)
    if n < 8:
        return [(f,)]
    third = n // 3
    halves = [(side, f[:h] if side == "a" else f[n - h :]) for h in range(max(2, n // 2 - 3), n // 2) for side in "ab"]
    return [*halves, ("c", n, f[:third]), ("d", n, f[third : n - third]), ("e", n, f[n - third :])]


class Furniture:
    """The lines of a text that are page marks: ``numbers`` and ``titles`` (a line may be both)."""

    def __init__(self, lines: list[str]):
        alone, beside = [], []
        bodies: dict[int, str] = {}
        for i, line in enumerate(lines):
            s = line.strip()
            if not s:
                continue
            if (m := _NUMBER.match(s)) and len(s) <= 24:
                alone.append((i, _value(m.group(1))))
                continue
            body = s
            if m := _BESIDE.match(s):
                value, body = (m.group(1), m.group(2)) if m.group(1) else (m.group(4), m.group(3))
                beside.append((i, int(value)))
            if len(body) >= 5 and not _TERMINAL.search(body) and not body[0].islower() and not _NO_TITLE.search(body):
                bodies[i] = body
        self.numbers = set(_sequence(alone))
        attached = set(_sequence(beside))
        groups: list[tuple[str, list[int]]] = []
        known: dict[tuple, list[int]] = {}
        for i, body in bodies.items():
            f = _fold(body)
            keys = _title_keys(f)
            for g in sorted({g for k in keys for g in known.get(k, ())}):
                if _alike(groups[g][0], f):
                    if i - groups[g][1][-1] >= 8:
                        groups[g][1].append(i)
                    break
            else:
                groups.append((f, [i]))
                for k in keys:
                    known.setdefault(k, []).append(len(groups) - 1)
        repeated = sorted((g for g in groups if len(g[1]) >= 2), key=lambda g: -len(g[1]))
        self.titles = {i for _, at in repeated[:3] for i in at}
        # of any number of further titles, those that stand at page breaks as the commonest do
        breaks = self.numbers | attached
        for _, at in repeated[3:]:
            if sum(any(i + d in breaks for d in (-2, -1, 0, 1, 2)) for i in at) * 2 > len(at):
                self.titles.update(at)
        if self.titles and len(self.titles) < 6 or attached:
            # a title that occurs once, beside a number of the sequence, on a two-title page order
            self.titles |= {i for i in attached if i in bodies and (self.titles or len(attached) >= 3)}
        if len(self.titles) == 2 and len(self.numbers) >= 3:  # left and right titles on three pages
            marks = sorted(self.numbers)
            for a, b in zip(marks, marks[1:]):
                for j in (a + 1, a + 2):
                    if j in bodies and a < j < b and not any(a < t < b for t in self.titles) and len(bodies[j]) < 45 and not re.search(r"[.!?,;]", bodies[j][:-1]):
                        self.titles.add(j)
        if len(self.titles) < 3:
            self.titles -= set() if self.titles & attached else self.titles
        self.attached = attached & self.titles
        self.n_numbers = len(self.numbers | self.attached)


CUT, MERGE = 4.0, 4.0  # costs of a space put in, or taken out

# -- decoding ----------------------------------------------------------------------------------------


class Repaired:
    """A text without its page marks, its words decoded; with the counts of what was mended."""

    def __init__(self, text: str, reader: Reader):
        self.reader = reader
        lines = text.split("\n")
        self.furniture = f = Furniture(lines) if len(lines) >= 6 else None
        marks = (f.numbers | f.titles) if f else set()
        self.hyphens = self.misread = 0
        body = [x.strip() for i, x in enumerate(lines) if i not in marks]
        # around a page's marks blank lines belong to the page break
        self.page_gap: set[int] = set()
        k = 0
        for i in range(len(lines)):
            if i in marks:
                self.page_gap.add(k)
            else:
                k += 1
        tokens = text.split()
        self.tight = _TIGHT_AT.search(text) is not None
        spaced = [t for t in tokens if not _TIGHT_AT.search(t)] if self.tight else tokens
        unknown = len(spaced) - sum(map(reader.plain.__getitem__, spaced))
        # where most words are unknown, an unknown word is likely there, and a known one by chance
        self.relief = 20.0 * max(0.0, unknown / max(1, len(spaced)) - 0.4)
        if not reader.noted(tokens, text):
            self.paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text.strip()) if p.strip()] if not marks else self._paragraphs(body)
            return
        self.paragraphs = self._paragraphs(body)

    def _paragraphs(self, lines: list[str]) -> list[str]:
        solid: list[tuple[str, int, bool]] = []  # line, blank lines before it, page break before it
        blank, paged = 0, False
        for i, x in enumerate(lines):
            paged = paged or i in self.page_gap
            if not x:
                blank += 1
                continue
            solid.append((x, blank, paged))
            blank, paged = 0, False
        if not solid:
            return []
        widths = sorted(len(x) for x, _, _ in solid)
        usual = widths[len(widths) * 3 // 4]
        # Least-cost choice of breaks: states are the last line's side of a break, costs from blank lines,
        # sentence ends, line fill and case; breaking twice within one line costs extra.
        cost = [0.0, 0.0]
        trail: list[tuple[int, int]] = []
        for i, (x, gap, page) in enumerate(solid):
            if i == 0:
                trail.append((1, 1))
                cost = [1e9, 0.0]
                continue
            prev = solid[i - 1][0]
            ended = bool(_TERMINAL.search(prev))
            brk = -3.0 if gap and not page else 0.3 if gap else 2.0 if not page else 1.5
            brk += -1.2 if ended else 3.2
            brk += 2.5 if x[0].islower() else 0.0
            brk += -0.8 if len(prev) < 0.75 * usual and ended else 0.0
            stay = [cost[0], cost[1]]
            new = [cost[0] + brk, cost[1] + brk + 0.4]
            a, b = (0, stay[0]) if stay[0] <= stay[1] else (1, stay[1])
            c, d = (0, new[0]) if new[0] <= new[1] else (1, new[1])
            cost = [b, d]
            trail.append((a, c))
        state = 0 if cost[0] <= cost[1] else 1
        starts = []
        for i in range(len(solid) - 1, -1, -1):
            if state == 1:
                starts.append(i)
            state = trail[i][state]
        starts = sorted({0, *starts})
        return [self._decode([x for x, _, _ in solid[a:b]]) for a, b in zip(starts, [*starts[1:], len(solid)])]

    def _decode(self, lines: list[str]) -> str:
        """Joint segmentation of the joined lines' characters into words.

        Known words outside of trouble stand. Every stretch around unknown words and hyphens at line ends is
        decoded by least cost over its characters, whose white space is but a hint: words may be kept, corrected by
        confusions, cut apart, merged over a space or a line end, or over a hyphen.
        """
        r = self.reader
        tokens, ends = self._tokens(lines)
        if not any(tokens[i][-1] in HYPHENS for i in ends) and all(map(r.plain.__getitem__, tokens)):
            return " ".join(tokens)
        n, out, i = len(tokens), [], 0
        broken = [k in ends and k + 1 < n and len(tokens[k]) > 1 and tokens[k][-1] in HYPHENS for k in range(n)]
        trouble = [broken[k] or k > 0 and broken[k - 1] or not r.plain[tokens[k]] for k in range(n)]
        while i < n:
            if not trouble[i]:
                out.append(tokens[i])
                i += 1
                continue
            j = i
            while j < n and trouble[j]:
                j += 1
            before = after = 0
            if any(self._puzzling(tokens[k], broken[k]) for k in range(i, j)):  # its neighbours may be parts of it
                before, after = min(2, len(out)), min(2, n - j)
                del out[len(out) - before :]
            words, hyphens, wrong = self._stretch(tokens[i - before : j + after], [k in ends for k in range(i - before, j + after)])
            out += words
            self.hyphens += hyphens
            self.misread += wrong
            i = j + after
        return " ".join(out)

    def _tokens(self, lines: list[str]) -> tuple[list[str], set[int]]:
        """The words of the lines and which of them end a line; between characters of scripts without spaces, breaks and spaces go where pairs of them usually have none."""
        tokens: list[str] = []
        ends: set[int] = set()
        counts = self.reader.counts
        for x in lines:
            if not self.tight:
                tokens += x.split()
                ends.add(len(tokens) - 1)
                continue
            for k, t in enumerate(x.split()):
                last = tokens[-1] if tokens else ""
                if last and _TIGHT_AT.match(t) and _TIGHT_AT.match(last[-1]):
                    whole, apart = counts.get("\x02" + last[-1] + t[0], 0), counts.get(f"\x02{last[-1]} {t[0]}", 0)
                    if whole > apart or whole == apart and k == 0 and "\u0e00" > t[0] or whole == apart and k == 0 and t[0] > "\u17ff":
                        tokens[-1] = last + t
                        continue
                tokens.append(t)
            ends.add(len(tokens) - 1)
        return tokens, ends

    def _puzzling(self, token: str, broken: bool) -> bool:
        """Whether nothing but its neighbours or a cut can explain a token: unknown, in lower case, not to be corrected."""
        c = core(token)
        return not broken and len(c) > 1 and c.islower() and c.isalpha() and not _TIGHT_AT.search(c) and c not in self.reader.counts and self.reader.meant(c) is None

    def _stretch(self, tokens: list[str], ended: list[bool]) -> tuple[list[str], int, int]:
        """(words, hyphens removed, words corrected) of a stretch, by a shortest path over its characters."""
        r = self.reader
        counts = r.counts
        stream = "".join(tokens)
        size, first, at = len(stream), {}, 0
        for k, t in enumerate(tokens):
            first[at] = k
            at += len(t)
        plain = [r.plain[t] for t in tokens]
        cut = [self._puzzling(t, e and t[-1] in HYPHENS) for t, e in zip(tokens, ended)]
        best: list[tuple[float, int, str, int, int]] = [(0.0, -1, "", 0, 0)] + [(math.inf, -1, "", 0, 0)] * size

        def offer(i: int, j: int, c: float, out: str, hyphen: int, wrong: int) -> None:
            if best[i][0] + c < best[j][0]:
                best[j] = (best[i][0] + c, i, out, hyphen, wrong)

        own = 0
        for i in range(size):
            own = first.get(i, own)
            if best[i][0] == math.inf:
                continue
            if i in first:
                self._whole_words(tokens, ended, own, i, offer)
            if any(cut[max(0, own - 2) : own + 3]):
                self._parts(stream, i, own, tokens, ended, plain, cut, first, offer)
        words: list[str] = []
        hyphens = wrong = 0
        j = size
        while j > 0:
            _, i, word, h, m = best[j]
            hyphens += h
            wrong += m
            words.append(word)
            j = i
        return words[::-1], hyphens, wrong

    def _whole_words(self, tokens: list[str], ended: list[bool], k: int, i: int, offer) -> None:
        """What a token may be as it stands: kept, corrected, or joined with the next over a hyphen at the line end."""
        r, token, j = self.reader, tokens[k], i + len(tokens[k])
        c = core(token)
        own = r.price[token]
        fixed = r.meant(c) if c else None
        unknown = bool(c) and c.lower() not in r.counts
        offer(i, j, own - (self.relief if unknown else 0.0), token, 0, 0)
        if fixed is not None:
            offer(i, j, r.cost(fixed) + 2.0, token.replace(c, _cased(c, fixed), 1), 0, 1)
        if ended[k] and k + 1 < len(tokens) and token[-1] in HYPHENS and len(token) > 1:
            right = tokens[k + 1]
            j += len(right)
            if r.joins(token, right):
                whole = token.rstrip(HYPHENS) + right
                w = core(whole)
                better = r.meant(w)
                price = min(r.cost(w.lower()), own)
                offer(i, j, min(price, r.cost(better)) if better else price, whole.replace(w, _cased(w, better), 1) if better else whole, 1, int(better is not None))
            else:
                offer(i, j, min(own, 1.0), token + right, 0, 0)

    def _parts(self, stream: str, i: int, k: int, tokens: list[str], ended: list[bool], plain: list[bool], cut: list[bool], first: dict[int, int], offer) -> None:
        """Words of the lexicon that begin at a character and end anywhere: inside a token, at its end, or in a later one."""
        r, size = self.reader, len(stream)
        crossed, puzzled, hyphens, surface = 0, cut[k], 0, ""
        for j in range(i + 1, min(size, i + LONGEST + 8) + 1):
            if j - 1 in first and j - 1 > i:  # over the space or line end before this character
                crossed += 1
                if ended[k] and surface[-1] in HYPHENS:
                    surface, hyphens = surface.rstrip(HYPHENS), hyphens + 1
                k = first[j - 1]
                puzzled = puzzled or cut[k]
                if crossed > 3:
                    return
            surface += stream[j - 1]
            whole = j == size or j in first
            if not puzzled or whole and not crossed and i in first:
                continue
            if not whole and not cut[k]:
                continue  # known words aren't cut
            w = (core(surface) if whole else surface).lower()
            if not w or not whole and not _LETTERS.fullmatch(w):
                continue
            price = MERGE * (crossed - hyphens) + (0.0 if whole else CUT)
            n = r.counts.get(w, 0)
            if n and (len(w) > 3 or n > 2e-4 * r.total):
                offer(i, j, r.cost(w) + price, surface, hyphens, 0)
            elif not n and whole and len(w) > 5 and w.isalpha() and (better := r.meant(w)):
                offer(i, j, r.cost(better) + price + 2.0, surface.replace(core(surface), _cased(core(surface), better), 1), hyphens, 1)


def _cased(like: str, word: str) -> str:
    if like.isupper() or sum(c.isupper() for c in like) > len(like) / 2 > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() or like[:1].isdigit() and word[:1].isalpha() and like[1:2].isupper() else word


def kinds_of(text: str, reader: Reader) -> list[str]:
    r = Repaired(text, reader)
    out = []
    if r.hyphens:
        out.append("hyphen")
    if r.misread >= 3:
        out.append("misread")
    if r.furniture and len(r.furniture.titles) >= 3:
        out.append("header")
    if r.furniture and r.furniture.n_numbers >= 2:
        out.append("page_number")
    return out


_readers: dict[int, Reader] = {}


def _reader_of(shared) -> Reader:
    key = id(shared)
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(*shared.value)
    return _readers[key]


def fit_reader(documents: DataFrame, proofread: DataFrame | None = None):
    """Broadcast (lexicon, confusions): the lexicon from all documents, confusions from all proofread pages."""
    pairs: list[tuple[str, str]] = []
    if proofread is not None:
        pairs = learn_confusions(documents.select("doc_id", "text").join(proofread.select("doc_id", "clean_text"), "doc_id"))
    return documents.sparkSession.sparkContext.broadcast((lexicon(documents), pairs))


def find_noise(df: DataFrame, reader, key: str, text: str = "text") -> DataFrame:
    """(key, noise): a row for each kind of noise a text has: hyphen, misread, header, page_number.

    Null and empty texts have none; repeated rows give repeated results. Narrow, without a shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _reader_of(reader)
        rows, kinds = [], []
        for row, t in enumerate(strings(batch, "_text")):
            if t and not t.isspace():
                for k in kinds_of(t, own):
                    rows.append(row), kinds.append(k)
        return pa.RecordBatch.from_arrays([column(batch, "_key").take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string())], ["_key", "noise"])

    out = map_batches(df.select(df[key].alias("_key"), df[text].alias("_text")), kernel, f"_key {kind}, noise string")
    return out.select(out["_key"].alias(key), "noise")


def repair(df: DataFrame, reader, key: str, text: str = "text") -> DataFrame:
    """(key, clean_text): each text without page marks, words decoded, its paragraphs parted by a blank line. Null stays null, blank becomes empty."""
    kind = df.schema[key].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _reader_of(reader)
        out = [None if t is None else "\n\n".join(Repaired(t, own).paragraphs) for t in strings(batch, "_text")]
        return pa.RecordBatch.from_arrays([column(batch, "_key"), pa.array(out, pa.string())], ["_key", "clean_text"])

    out = map_batches(df.select(df[key].alias("_key"), df[text].alias("_text")), kernel, f"_key {kind}, clean_text string")
    return out.select(out["_key"].alias(key), "clean_text")
