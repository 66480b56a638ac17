"""Sentence boundaries by linear-chain taggers with Viterbi decoding, learned from the corpus' own paragraphs."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.arrow import column, map_batches, strings
from brindle.plans.physical import cut_lineage, spread

TRAIN_PER_SCRIPT = 200  # texts of each script that the taggers are fitted on, at most
BARE_TEXTS = 80  # of those, texts that the taggers for text without marks are fitted on
STEPS, LINEAR = 120, 0.15  # of the fit: rounds, step size
SHARE = 0.25  # of the usual share of paragraph ends that makes a context one of sentence ends; at others there are hardly any
LEAST_SHARE = 1e-6  # of all places counted that a word must make up to be kept: a million words at most

OPENERS, CLOSERS = "“„«「『‹（([【¿¡", "”»」』›）)]】’"
_PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›"}
_MARKS = ".!?。！？।؟…"
_SPOT = re.compile(r"\n[^\S\n]*\n|[.!?。！？।؟…]+|[“”„«»「」『』‹›\"]")
_TH_SPOT = re.compile(r"\s+")
_BLANK = re.compile(r"\n\s*\n")
_AFTER = re.compile(r"(?:\s?[»]|[\"”“’»)\]」』›）】])*")
_GLUED = re.compile(r"^.*[^\W\d_]{3,}[.!?](?=[^\W\d_])|^.*['’]")
_TOKEN = re.compile(r"[^\s\"“„«「『(（\[¿¡—:：,，、;]{1,24}$")


def script_of(text: str) -> str:
    """'thai' where most letters are Thai, 'cjk' for Han and kana, 'other' for the rest."""
    thai = len(re.findall(r"[ก-๎]", text))
    cjk = len(re.findall(r"[぀-ヿ㐀-鿿]", text))
    letters = max(1, len(re.findall(r"[^\W\d_]", text)))
    return "thai" if thai * 2 > letters else "cjk" if cjk * 2 > letters else "other"


def _next_class(c: str) -> str:
    if not c:
        return "end"
    if c.isdigit():
        return "9"
    if c in OPENERS or c in '"—–':
        return "open"
    if c.islower():
        return "low"
    if c.isupper():
        return "up"
    if c in "とっ":
        return "quoting"
    if "぀" <= c <= "鿿":
        return "cjk"
    if c.isalpha():
        return "let"
    return "punct" if c in ",;:、，；：،؛)-%" else "other"


class Spot:
    """A place that may end a sentence: the tag boundary is open to it, all other characters are inside.

    ``context`` is what is seen around it; ``sure``: a blank line or the end of the text; ``last``: a blank line
    follows a mark (in Thai, the text simply stops there), and another paragraph goes on after it.
    """

    __slots__ = ("end", "context", "sure", "last")

    def __init__(self, end: int, context: tuple, sure: bool, last: bool):
        self.end, self.context, self.sure, self.last = end, context, sure, last


def _kind(c: str) -> str:
    return "9" if c.isdigit() else "m" if c in _MARKS or c in ",:;" else "q" if c in OPENERS + CLOSERS + '"' else "th" if "\u0e00" <= c <= "\u0e7f" else "let" if c.isalpha() else "other"


def _thai_spots(text: str) -> Iterator[Spot]:
    for m in _TH_SPOT.finditer(text):
        a, b = m.span()
        if a == 0 or b == len(text):
            continue
        blank = m.group().count("\n") > 1
        yield Spot(a, ("th", _kind(text[a - 1]), _kind(text[b])), blank, blank)


def _spots(text: str) -> Iterator[Spot]:
    """Places in order, with their contexts."""
    if script_of(text) == "thai":
        yield from _thai_spots(text)
        return
    inside, introduced = "", False  # the closers awaited; whether words of its sentence precede the quotation
    start, pos, n = 0, 0, len(text)  # start: of what comes after the last mark that may end a sentence
    last_end = -1
    for m in _SPOT.finditer(text):
        a, b = m.span()
        if a < pos:
            continue
        hit = m.group()
        if hit[0] == "\n":
            stop = len(text[:a].rstrip()) if a else 0
            if stop > max(last_end, 0):
                yield Spot(stop, (), True, False)
                last_end = stop
            inside, start = "", b
            continue
        if hit[0] not in _MARKS:
            if inside and hit in inside:
                inside = ""
            elif not inside and (hit in _PAIRS or hit == '"'):
                inside, introduced = _PAIRS.get(hit, '"'), bool(text[start:a].strip())
            continue
        tail = _AFTER.match(text, b).group()
        closed = ""
        if tail:
            took = 0
            for i, c in enumerate(tail):
                if c in '"“”»」』›':
                    if inside and c in inside:
                        inside, closed, took = "", "intro" if introduced else "first", i + 1
                    else:
                        break
                elif c in ")]）】’":
                    took = i + 1
                elif not c.isspace():
                    break
            b += took
        rest = text[b : b + 40]
        trimmed = rest.lstrip()
        gap = rest[: len(rest) - len(trimmed)]
        nxt = trimmed[:1]
        if not nxt and b + 40 < n:
            trimmed = text[b:].lstrip()[:40]
            gap = text[b : text.index(trimmed, b)] if trimmed else ""
            nxt = trimmed[:1]
        cls = _next_class(nxt)
        if nxt == "»" or (nxt == '"' and inside == '"'):
            cls = "punct"
        dash = nxt in "—–" and trimmed[1:2].islower()
        mark = "..." if hit.startswith("..") or "…" in hit else hit[0]
        word = (_TOKEN.search(text, max(0, a - 24), a) or [""])[0] if mark == "." else ""
        word = _GLUED.sub("", word)  # "clause.Dr" where the space is missing, "l'art"
        after = _WORD.match(trimmed)[0][:24].lower() if cls in ("up", "let") else ""
        quote = "in" if inside else closed or "out"
        context = (mark, word, cls, mark == "." and cls == "9" and not gap, quote, after, dash)
        pos = b
        blank = gap.count("\n") > 1
        if blank or not nxt:
            start, last_end, inside = b, b, ""
            yield Spot(b, context, True, bool(nxt) and blank)
            continue
        if not inside and cls not in ("low", "punct", "quoting") and not (mark == "." and len(word) == 1):
            start = b  # what a quotation that follows is introduced by, if by anything
        yield Spot(b, context, False, False)
    stop = len(text.rstrip())
    if stop > max(last_end, 0):
        yield Spot(stop, (), True, False)


_WORD = re.compile(r"\w*")
_SHORT_NUMBER = re.compile(r"\d{1,2}")


def _counted(context: tuple) -> list[str]:
    """What of a context is counted over the corpus: the word before a full stop, and the word after a short number and a full stop, which may make it an ordinal."""
    if not context or context[0] == "th":
        return []
    mark, word, cls, _, quote, after, _ = context
    if quote == "in" or cls in ("low", "punct", "quoting"):
        return []
    out = ["*"]
    if mark == "." and word:
        out.append("p" + word.lower())
        if after and _SHORT_NUMBER.fullmatch(word):
            out.append("n" + after)
    return out


class Model:
    """Counts of words at places that may end a sentence (all, paragraph ends), weights of the tagger, weights of that for text without marks."""

    def __init__(self, counts: dict[str, tuple[int, int]], weights: dict[str, float] | None = None, bare: dict[str, dict[str, float]] | None = None):
        self.counts, self.weights, self.bare = counts, dict(PRIOR) if weights is None else weights, bare or {}
        n, s = counts.get("*", (0, 0))
        self.usual = s / n if n else 0.0
        self.kinds: dict[str, str] = {}

    def found(self, key: str) -> str:
        """How often a word stands at paragraph ends (or begins paragraphs) against what is usual, where chance can't explain it: N never, S seldom; else F freely, U can't be said."""
        if key not in self.kinds:
            n, s = self.counts.get(key, (0, 0))
            due = n * self.usual
            few = due > 6 and s < 0.5 * due and _poisson(s, due) < 1e-3
            self.kinds[key] = "N" if few and s < 0.15 * due else "S" if few else "F" if due >= 2 else "U"
        return self.kinds[key]

    def features(self, context: tuple) -> list[str]:
        if context[0] == "th":
            return [f"th{context[1]}", f"ht{context[2]}", f"thht{context[1]}{context[2]}", "th"]
        mark, word, cls, tight, quote, after, dash = context
        low = word.lower()
        shape = "-"
        if mark == ".":
            shape = "I" if len(word) == 1 and word.isalpha() else "d" if _SHORT_NUMBER.fullmatch(low) else "D" if low[-1:].isdigit() else self.found("p" + low)
        begins = self.found("n" + after) if after and shape == "d" else "-"
        return [f"m{mark}", f"w{shape}{cls}", f"q{quote}{cls}", f"v{begins}", f"wv{shape}{begins}", f"mq{mark}{quote}", f"c{cls}", f"l{dash:d}{cls}", f"g{tight:d}", f"x{mark}{shape}{cls}{quote}"]

    def score(self, context: tuple) -> float:
        w = self.weights
        return w.get("bias", 0.0) + sum(w.get(f, 0.0) for f in self.features(context))


# Of the tagger before it is fitted, and where no text has paragraphs to learn from: a mark ends a sentence unless what follows goes on with it.
PRIOR = {"bias": 2.0, "clow": -4.0, "cpunct": -4.0, "cquoting": -4.0, "wI up": -4.0, "g1": -4.0, "th9": -4.0, "ht9": -4.0, "wIup": -4.0, **{f"qin{c}": -4.0 for c in ("low", "up", "let", "cjk", "open", "9", "other", "end", "punct")}}


def _poisson(s: int, mean: float) -> float:
    """Chance of at most s where ``mean`` are due."""
    term = total = math.exp(-mean) if mean < 700 else 0.0
    for k in range(1, s + 1):
        term *= mean / k
        total += term
    return total


def _viterbi(scores: list[float], turns: tuple[float, float]) -> list[bool]:
    """The best tags (True: boundary) for emission scores of boundary against inside; turns: what boundary after inside, and after boundary, adds."""
    if not scores:
        return []
    after_in, after_b = turns
    best, back = [0.0, -1e9], []
    for e in scores:
        inside = (best[0], 0) if best[0] >= best[1] else (best[1], 1)
        bound = (best[0] + after_in, 0) if best[0] + after_in >= best[1] + after_b else (best[1] + after_b, 1)
        best = [inside[0], bound[0] + e]
        back.append((inside[1], bound[1]))
    tag, tags = int(best[1] > best[0]), []
    for p in reversed(back):
        tags.append(bool(tag))
        tag = p[tag]
    return tags[::-1]


def _logistic(rows: list[list[str]], labels: np.ndarray, least: int = 2) -> tuple[dict[str, float], np.ndarray]:
    """(weights, probabilities) of a regularised logistic model on indicator features, by Adam over all rows."""
    seen = Counter(f for r in rows for f in r)
    at = {f: i for i, (f, n) in enumerate(sorted(seen.items())) if n >= least}
    at = {f: i for i, f in enumerate(at)}
    flat = np.array([at[f] for r in rows for f in r if f in at], np.int64)
    row = np.repeat(np.arange(len(rows)), [sum(f in at for f in r) for r in rows])
    w, bias = np.zeros(len(at)), float(np.log(max(labels.mean(), 1e-6) / max(1 - labels.mean(), 1e-6)))
    m, v, mb, vb = np.zeros(len(at)), np.zeros(len(at)), 0.0, 0.0
    p = np.zeros(len(rows))
    for k in range(1, STEPS + 1):
        z = bias + np.bincount(row, w[flat], minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        off = p - labels
        g = np.bincount(flat, off[row], minlength=len(at)) / len(rows) + 1e-6 * w
        gb = off.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= LINEAR * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        bias -= LINEAR * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-8)
    weights = {f: round(float(w[i]), 5) for f, i in at.items() if abs(w[i]) > 1e-3}
    weights["bias"] = round(bias, 5)
    return weights, p


def train(texts: list[str], counts: dict[str, tuple[int, int]] | None = None) -> Model:
    """The taggers, learned from where paragraphs end.

    A paragraph's last mark surely ends a sentence, and what the next paragraph begins with surely begins one;
    of all other marks nothing is known. Paragraphs end after any of their sentences, so a context is a
    sentence's end where paragraph ends are about as frequent in it as among all ends, and not where they hardly
    occur (learning from positive and unlabelled examples): a logistic model gives the share of paragraph ends in
    a context, and a mark is a boundary from SHARE of the mean share at paragraph ends on. The marks so
    labelled give the chain's transitions. For scripts without spaces or marks a second tagger looks at the characters
    on both sides of every place, trained on the same texts with their marks (in Thai, spaces) taken out.
    """
    if counts is None:
        counts = {}
        for t in texts:
            for key, (n, s) in count_places(t).items():
                a, b = counts.get(key, (0, 0))
                counts[key] = (a + n, b + s)
    model = Model(counts)
    chains = [own for t in texts if (own := [x for x in _spots(t) if x.context and (not x.sure or x.last)]) and any(x.last for x in own)]
    rows = [model.features(x.context) for own in chains for x in own]
    labels = np.array([x.last for own in chains for x in own], float)
    if labels.sum() >= 20:
        weights, p = _logistic(rows, labels)
        bar = float(p[labels > 0].mean()) * SHARE
        weights["bias"] -= float(np.log(bar / (1 - bar)))
        model.weights = weights
        tags, k = (p > bar) | (labels > 0), 0
        after = np.ones((2, 2))
        for own in chains:
            for x, y in zip(tags[k : k + len(own)], tags[k + 1 : k + len(own)]):
                after[int(x), int(y)] += 1
            k += len(own)
        share = (after / after.sum(axis=1, keepdims=True))[:, 1]
        mean = max(1e-3, min(0.999, float(tags.mean())))
        # what the tag before adds to what the marks themselves say, lightly
        weights["I>B"], weights["B>B"] = (float(np.clip(np.log(x / (1 - x)) - np.log(mean / (1 - mean)), -1, 1)) * 0.1 for x in share)
    for script in ("cjk", "thai"):
        if own := _train_bare([t for t in texts if script_of(t) == script][:BARE_TEXTS], model):
            model.bare[script] = own
    return model


# -- text without marks -------------------------------------------------------------------------------

_BARE_OUT = {"cjk": re.compile(r"[.!?。！？…\s“”„«»「」『』\"]+"), "thai": re.compile(r"[\s“”\"]+")}


def _around(x: str, i: int) -> tuple[str, ...]:
    """Features of a boundary before character i."""
    a, b = x[max(0, i - 3) : i], x[i : i + 3]
    return (f"a{a}", f"b{b}", f"c{a[-2:]}", f"d{b[:2]}", f"e{a[-1:]}", f"f{b[:1]}", f"g{a[-1:]}{b[:1]}", f"h{a[-2:]}|{b[:2]}")


def _stripped(text: str, ends: list[int], script: str) -> tuple[str, list[int]]:
    """(text without marks, ends in it)."""
    out, places, at = [], [], 0
    for e in ends:
        part = _BARE_OUT[script].sub("", text[at:e])
        at = e
        if part:
            out.append(part)
            places.append(len(part) + (places[-1] if places else 0))
    return "".join(out), places


def _train_bare(texts: list[str], model: Model) -> dict[str, float] | None:
    rows, labels, sizes = [], [], []
    for t in texts:
        for p in _BLANK.split(t):
            x, ends = _stripped(p, sentence_ends(p, model), script := script_of(t))
            if len(ends) > 1:
                right = set(ends)
                sizes += np.diff([0, *ends]).tolist()
                rows += [list(_around(x, i)) for i in range(1, len(x))]
                labels += [i in right for i in range(1, len(x))]
    if sum(labels) < 50:
        return None
    weights, _ = _logistic(rows, np.array(labels, float))
    return {f: w for f, w in weights.items() if abs(w) > 0.05 or f == "bias"} | {"size": float(np.mean(sizes))}


SEVERAL, DOUBT = 2.5, 1.0  # sentences that a paragraph without marks must be long enough for; what a boundary must score there


def _bare_ends(text: str, script: str, model: Model) -> list[int]:
    """Ends within a paragraph that has no mark."""
    w = model.bare[script]
    scores = [w["bias"] - DOUBT + sum(w.get(f, 0.0) for f in _around(text, i)) for i in range(1, len(text))]
    return [i + 1 for i, tag in enumerate(_viterbi(scores, (0.0, -6.0))) if tag and not text[i + 1].isspace()]


def sentence_ends(text: str | None, model: Model) -> list[int]:
    """Ends of the sentences of a text, in characters. White space alone gives none."""
    if not text or not text.strip():
        return []
    spots = list(_spots(text))
    scores = [1e6 if s.sure else model.score(s.context) for s in spots]
    turns = model.weights.get("I>B", 0.0), model.weights.get("B>B", 0.0)
    ends = [s.end for s, t in zip(spots, _viterbi(scores, turns)) if t]
    last = len(text.rstrip())
    if not ends or ends[-1] < last:
        ends.append(last)
    if model.bare and (script := script_of(text)) in model.bare:
        at = 0
        for m in [*_BLANK.finditer(text), None]:
            stop = m.start() if m else last
            part = text[at:stop]
            if len(part.strip()) >= SEVERAL * model.bare[script]["size"] and not (_TH_SPOT if script == "thai" else _ANY_MARK).search(part.strip()) and not _LISTED.search(part):
                ends += [at + e for e in _bare_ends(part, script, model)]
            at = m.end() if m else stop
    return sorted({e for e in ends if text[:e].strip()})


_ANY_MARK = re.compile("[.!?。！？…\n]")
_LISTED = re.compile(r"\t|  |\||;|；")


def count_places(text: str) -> dict[str, tuple[int, int]]:
    """Counts (all, at a paragraph's end) of the words beside a text's marks, if it has several paragraphs."""
    spots = [x for x in _spots(text) if x.context and (not x.sure or x.last)]
    if not any(x.last for x in spots):
        return {}
    every, last = Counter(), Counter()
    for x in spots:
        keys = _counted(x.context)
        every.update(keys)
        if x.last:
            last.update(keys)
    return {k: (n, last[k]) for k, n in every.items()}


def corpus_counts(documents: DataFrame, text: str = "text") -> dict[str, tuple[int, int]]:
    """``count_places`` added up over all documents; words under a millionth of all places aren't kept."""
    texts = spread(documents.select(F.col(text).alias("t")).where(F.col("t").rlike(r"\n\s*\n")), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, last = Counter(), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                for k, (n, s) in count_places(t).items():
                    every[k] += n
                    last[k] += s
            if len(every) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(every.keys(), pa.string()), pa.array(every.values(), pa.int64()), pa.array([last[k] for k in every], pa.int64())], ["k", "n", "s"])
                every.clear(), last.clear()
        if every:
            yield pa.RecordBatch.from_arrays([pa.array(every.keys(), pa.string()), pa.array(every.values(), pa.int64()), pa.array([last[k] for k in every], pa.int64())], ["k", "n", "s"])

    sums = cut_lineage(texts.mapInArrow(run, "k string, n long, s long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    total = sums.where("k = '*'").first()
    if total is None:
        return {}
    kept = sums.where((F.col("n") * total.s >= 2 * total.n) & (F.col("n") >= LEAST_SHARE * total.n))  # of others nothing can be said
    return {r.k: (r.n, r.s) for r in kept.toLocalIterator()}


def fit(documents: DataFrame, text: str = "text", per_script: int = TRAIN_PER_SCRIPT) -> Model:
    """Counts over all documents; weights on a bounded sample: of each script, the ``per_script`` texts of up to 6,000 characters, in several paragraphs if there are such, whose hashes are lowest."""
    letters = F.regexp_replace(F.substring(F.col(text), 1, 400), r"[\s\p{P}\d]", "")
    ranges = {"latin": r"\p{IsLatin}", "han": r"\p{IsHan}", "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "deva": r"\p{IsDevanagari}", "thai": r"\p{IsThai}", "arab": r"\p{IsArabic}"}
    script = F.lit("none")
    for name, pattern in ranges.items():
        script = F.when(F.length(F.regexp_replace(letters, pattern, "")) * 2 < F.length(letters), name).otherwise(script)
    script = F.when(script != "latin", script).otherwise(F.concat(F.lit("latin"), F.pmod(F.length(text), F.lit(4)).cast("string")))
    base = documents.select(F.col(text).alias("text")).where(F.length(text).between(80, 6000))
    base = base.select("text", script.alias("script"), F.col("text").rlike(r"\S\s*\n\s*\n\s*\S").alias("parted"), F.xxhash64("text").alias("h"))
    w = Window.partitionBy("script").orderBy(F.desc("parted"), "h")
    top = base.select("script", "parted", "h", F.row_number().over(w).alias("k")).where(F.col("k") <= per_script)
    sample = base.join(F.broadcast(top.select("h").distinct()), "h").dropDuplicates(["h"]).orderBy("h")  # scripts x per_script hashes
    return train([r.text for r in sample.select("text", "h").collect()], corpus_counts(documents, text))


def split_sentences(df: DataFrame, model: Model, key: str, text: str = "text") -> DataFrame:
    """(key, sent_no from 0, sent_start, sent_end): the sentences of every text in order, by character offsets.

    A blank line and the end of the text always end a sentence. Null, empty and blank texts have no
    sentence. Repeated rows give repeated results; extra columns are not read; the model is sent
    to every task once. Narrow, without a shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, no, starts, ends = [], [], [], []
        for row, t in enumerate(strings(batch, "_text")):
            at = 0
            for k, e in enumerate(sentence_ends(t, shared.value)):
                while t[at].isspace():
                    at += 1
                rows.append(row), no.append(k), starts.append(at), ends.append(e)
                at = e
        taken = column(batch, "_key").take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([taken, pa.array(no, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["_key", "sent_no", "sent_start", "sent_end"])

    out = map_batches(df.select(df[key].alias("_key"), df[text].alias("_text")), kernel, f"_key {kind}, sent_no int, sent_start long, sent_end long")
    return out.select(out["_key"].alias(key), "sent_no", "sent_start", "sent_end")
