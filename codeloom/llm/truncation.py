"""Problem 10: texts that were cut off, by logistic regression on hashed features.

The limits of each source are lengths at which its texts pile up, counted over all texts; the
vocabulary, with how often a word ends a line, is counted over all texts as well. A bounded sample of
texts is cut artificially, at random places and at limits, with and without a mark of omission, which
gives the positives; the texts as stored are the negatives, those among them that a first fit takes
for cut left out of the second. Every text is then scored by the features of its end: closing
characters, punctuation, brackets and fences left open, the last word, the length against the limits.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.base import written

#: Texts on which the classifier is fitted, and slots of its hashed features.
SAMPLE, SLOTS = 12_000, 1 << 15

#: A character that is no blank of any kind.
NOT_BLANK = r"[^\s\x{85}\x{a0}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Sources that must have the very same text for it to count as common, and for it to be whole: the same cut would have had to happen in each.
COMMON, SURELY = 4, 8

_STRINGS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Marks of omission.
_MARKS = ("[...]", "...", "…", "[truncated]")
_ENDS = ".!?。！？…"


def _kind_of(c: str) -> str:
    if c.isalpha():
        return "c" if ord(c) > 0x2E7F else ("A" if c.isupper() else "a") if c.isascii() else "l"
    return "9" if c.isdigit() else "_" if c in " \t 　" else "n" if c in "\r\n" else c if ord(c) < 0x3100 else "*"


def _line_type(line: str) -> str:
    s = line.strip()
    if not s:
        return "blank"
    if s.startswith("```"):
        return "fence"
    if s[0] == "|":
        return "row" if s[-1] == "|" and len(s) > 1 else "rowopen"
    if re.match(r"(?:[-*+•]|\d+[.)])\s", s):
        return "item"
    if s[0] == "#":
        return "head"
    if re.search(r"https?://\S+$", s):
        return "url" if re.search(r"https?://[\w-]+(?:\.[\w-]+)+(?:/[\w.-]+)*/?$", s) else "urlopen"
    if re.match(r"[\w.-]+\s*[:=]\s*\S+$", s):
        return "pair"
    if re.match(r"[\w-]+(?:\s--?[\w-]+(?:[ =]\S+)?)+$", s):
        return "command"
    if re.match(r"[\w-]+(?:-by|-to)?: .*<\S*>?$", s):
        return "trailer" if s[-1] == ">" else "traileropen"
    if re.search(r"[{};=()<>]", s) and re.search(r"[{};]\s*$|^\s*(?:return|if|for|while|import|from|def|var|const|let|func|\}|//|#)|[\w\])]\s=\s", line):
        return "code"
    return "prose"


def describe(text: str, kind: str | None, chars: list[int], octets: list[int]) -> tuple[list[str], str, str, bool]:
    """The features of a text with the limits of its source, its last word (with a blank behind if something follows it), its last two, and whether it is closed."""
    k = kind or "?"
    lines = text.rstrip("\r\n").split("\n")
    last = lines[-1].rstrip("\r")
    before = next((x for x in reversed(lines[:-1]) if x.strip()), "")
    body = text.rstrip()
    newline = text != text.rstrip("\r\n")
    c = [_kind_of(x) for x in body[-3:]]
    c1, c2 = c[-1], "".join(c[-2:])
    closed = body[-1] in _ENDS + "\"'”’」)]}>`|:;"
    t = _line_type(last)
    single = len(lines) == 1
    n_words = len(last.split())
    anywhere = any(e in body for e in _ENDS)
    inner = sum(x.rstrip()[-1:] in _ENDS for x in lines[:-1])
    f = [
        f"c1{c1}", f"c2{c2}", f"c3{''.join(c)}", f"k{k}{c1}", f"k{k}n{newline}", f"t{t}", f"t{t}{c1}", f"k{k}t{t}{closed}", f"t{t}{c2}", f"nl{newline}{t}{closed}",
        f"closed{closed}{single}{anywhere}", f"w{min(n_words, 12)}{t}{closed}", f"sp{text[-1:].isspace()}{closed}{newline}", f"prose{t == 'prose'}{closed}{inner > 0}{k}", f"single{single}{anywhere}{closed}{min(n_words, 8)}{k}",
    ]
    trail = text[len(body) :]
    if trail:
        f.append(f"trail{min(3, len(trail))}{trail == ' '}{closed}")
    if body.count("```") % 2:
        f.append("fence")
        f.append(f"fence{t}")
    bare = _STRINGS.sub("", body)
    for a, z in ("()", "[]", "{}"):
        d = bare.count(a) - bare.count(z)
        if d:
            f += [f"open{a}{min(max(d, -2), 3)}", f"open{a}{d > 0}{k}"]
    if body[0] in "{[":
        try:
            json.loads(body)
            f.append("jsonok")
        except ValueError:
            f.append(f"jsonbad{k}")
    if last.count('"') % 2:
        f.append(f"quote{t}")
    if last.count("`") % 2:
        f.append("tick")
    if k == "code" or t == "code":
        f += [f"code{newline}{c1}", f"codein{last[:1].isspace()}{newline}", f"codek{c2}{newline}"]
    same = _line_type(before) == t
    if before:
        pb = before.rstrip()[-1:]
        f += [f"prev{same}{t}{(pb in _ENDS) == (body[-1] in _ENDS)}", f"prevc{_kind_of(pb) if pb else ''}{c1}{t}", f"prevt{_line_type(before)}{t}{closed}"]
        if t in ("row", "rowopen"):
            f.append(f"cells{last.count('|') == before.count('|')}")
    mark = next((x for x in _MARKS if body.endswith(x)), "")
    if mark and not (body[-len(mark) - 1 : -len(mark)] or " ").isspace():
        f += [f"mark{_kind_of(body[-len(mark) - 1])}{len(body) > 60}", f"mark{len(body) > 60}{inner > 0 or anywhere}"]
    first_word, last_word = _last_two(body)
    tail = body[-1].isalpha()
    if tail and len(body) > 2 and body[-2].isspace():
        f.append(f"alone{body[-3] in '.!?。！？'}{body[-1].isascii()}")
    n, b = len(text), len(text.encode())
    at = n in chars or any(x - 3 <= b <= x for x in octets)  # a cut in bytes may take away a character's
    f += [f"limit{at}{closed}", f"at{at}{c1 in 'aAlc9_'}{t}", f"limits{bool(chars or octets)}{at}", f"atc{at}{c1}", f"atk{at}{k}"]
    last_word = last_word.lower()
    return f, last_word + ("" if tail else " "), f"{first_word.lower()} {last_word}" if first_word else "", closed


def _letters_before(text: str, end: int) -> int:
    while end and text[end - 1].isalnum() and not text[end - 1].isdecimal():
        end -= 1
    return end


def _last_two(body: str) -> tuple[str, str]:
    """The last word, which up to three other characters may follow, and the word right before it, or empty strings."""
    end = len(body)
    while end and len(body) - end < 3 and not (body[end - 1].isalnum() or body[end - 1] == "_"):
        end -= 1
    start = _letters_before(body, end)
    gap = start
    while gap and body[gap - 1].isspace():
        gap -= 1
    first = _letters_before(body, gap) if gap < start else gap
    return body[first:gap] if start < end else "", body[start:end]


def _slots(features: list[str]) -> list[int]:
    return sorted({zlib.crc32(x.encode()) % SLOTS for x in features})


def _word_features(n: int | None, ends: int | None, whole: bool, common: bool, closed: bool, like: int | None) -> list[str]:
    """like: how many different texts end in the same two words, if these are what most texts with the same last word end in."""
    n, ends, like = n or 0, ends or 0, like or 0
    size = 0 if n < 1 else min(6, n.bit_length())
    share = 0 if not ends else 1 + min(4, int(np.log2(max(1.0, n / ends))) // 2)
    alike = min(4, like.bit_length() // 2) if share in (1, 2) else 0
    return [f"vn{size}{whole}", f"ve{share}{whole}", f"vne{size}{share}{whole}", f"common{common}", f"common{common}{closed}", f"like{alike}", f"like{alike}{closed}"]


def limits(docs: DataFrame, least: int = 3) -> DataFrame:
    """source, chars and octets: the lengths at which the texts of a source pile up, in characters and in bytes; docs has source, n, b and h of each text.

    Different texts are counted: at least so many must have a length, more than the six lengths on
    either side have together, and six times as many as its wider neighbourhood would have it.
    """
    texts = docs.select("source", "n", "b", "h")
    both = texts.select("source", "h", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n").alias("length")), F.struct(F.lit("octets").alias("unit"), F.col("b").alias("length")))).alias("x"))
    counts = both.select("source", "x.unit", "x.length", "h").distinct().groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.withColumn("beside", F.sum("m").over(Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-6, 6)) - F.col("m"))
    # lengths within a tenth of one another, by cells of a logarithmic scale and the ones beside them
    cell = F.floor(F.log(F.col("length") + 1) * 10)
    near = counts.select("source", "unit", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"), "m").groupBy("source", "unit", "cell").agg(F.sum("m").alias("around"))
    width = (F.exp(F.col("cell") / 10) * 0.35)
    high = counts.withColumn("cell", cell).join(near, ["source", "unit", "cell"]).where((F.col("length") >= 60) & (F.col("m") >= least) & (F.col("m") > F.col("beside")) & (F.col("m") > 6 * (F.col("around") - F.col("m")) / width + 2))
    return high.groupBy("source").agg(F.sort_array(F.collect_list(F.when(F.col("unit") == "chars", F.col("length")))).alias("chars"), F.sort_array(F.collect_list(F.when(F.col("unit") == "octets", F.col("length")))).alias("octets"))


SCHEMA = "doc_id bigint, h bigint, label int, slots array<int>, word string, pair string, closed boolean, n bigint, ends bigint"
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
#: Labels of rows: a text as stored, one of the two lessons it gives (intact, cut), a word with its counts.
STORED, INTACT, CUT, WORD = 0, 1, 2, 3


def _last_words(low: str) -> Iterator[str]:
    for line in low.split("\n"):
        line = line.rstrip()
        if line and line[-1].isalpha():
            yield _LETTERS.findall(line.rsplit(None, 1)[-1])[-1]


def _lessons(text: str, h: int, kind: str | None, chars: list[int], octets: list[int], everywhere: list[tuple[str, int]]) -> Iterator[tuple]:
    """The text as if it were intact, and cut: at any place, or at a limit in characters or bytes that some source has."""
    rng = np.random.default_rng(abs(h) % (1 << 31))
    # an intact text may have a limit's length by chance
    chance = rng.random() < 0.06
    size = len(text.encode())
    f, *more = describe(text, kind, [len(text)] if chance else [x for x in chars if x != len(text)], [x for x in octets if not x - 3 <= size <= x])
    yield INTACT, f, more
    if len(text) <= 40:
        return
    at = int(rng.integers(max(20, len(text) // 12), len(text)))
    part, as_chars, as_octets = text[:at], [], []
    fits = [(u, x) for u, x in everywhere if x < (len(text) if u == "chars" else size)]
    if fits and rng.random() < 0.6:
        unit, x = fits[int(rng.integers(len(fits)))]
        if unit == "chars":
            mark = "" if rng.random() >= 0.2 else "..." if rng.random() < 0.6 else "…"
            part, as_chars = text[: x - len(mark)] + mark, [x]
        else:
            part, as_octets = text.encode()[:x].decode(errors="ignore"), [x]
    if part.strip():
        f, *more = describe(part, kind, as_chars, as_octets)
        yield CUT, f, more


def _read(docs: DataFrame, share: int, everywhere: list[tuple[str, int]]) -> DataFrame:
    """In one pass over the texts: the features of each, the lessons of some, and how often each word occurs and ends a line."""
    shared = docs.sparkSession.sparkContext.broadcast(everywhere)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        ends: Counter[str] = Counter()

        def batch(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * len(_TYPES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], ["doc_id", "h", "label", "slots", "word", "pair", "closed", "n", "ends"])

        def counted() -> pa.RecordBatch:
            out = batch([(None, None, WORD, None, w, None, None, c, ends[w]) for w, c in n.items()])
            n.clear()
            ends.clear()
            return out

        for b in batches:
            for k in range(0, b.num_rows, 1024):
                out: list[tuple] = []
                for doc, h, text, kind, chars, octets, taught in zip(*[c.to_pylist() for c in b.slice(k, 1024).columns], strict=True):
                    chars, octets = chars or [], octets or []
                    f, word, pair, closed = describe(text, kind, chars, octets)
                    out.append((doc, h, STORED, _slots(f), word, pair, closed, None, None))
                    if taught:
                        out += [(doc, h, label, _slots(f), *more, None, None) for label, f, more in _lessons(text, h, kind, chars, octets, shared.value)]
                    low = text.lower()
                    n.update(_LETTERS.findall(low))
                    ends.update(_last_words(low))
                yield batch(out)
                if len(n) > 300_000:
                    yield counted()
        yield counted()

    taught = F.pmod(F.xxhash64("h", F.lit(7)), F.lit(1_000_000)) < share
    return docs.select("doc_id", "h", "text", "doc_kind", "chars", "octets", taught.alias("taught")).mapInArrow(run, SCHEMA)


def fit(slots: list[list[int]], labels: np.ndarray, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Weights of a logistic regression with one slot more for the intercept, by gradient steps of adaptive size."""
    rng = np.random.default_rng(seed)
    width = max((len(s) for s in slots), default=1)
    x = np.full((len(slots), width), SLOTS + 1)
    for i, s in enumerate(slots):
        x[i, : len(s)] = s
    w, g = np.zeros(SLOTS + 2), np.full(SLOTS + 2, 1e-3)
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 64):
            i = order[k : k + 64]
            p = 1 / (1 + np.exp(-np.clip(w[x[i]].sum(axis=1) + w[SLOTS], -30, 30)))
            e = (p - labels[i]) / len(i)
            grad = np.bincount(x[i].ravel(), np.repeat(e, width), SLOTS + 2)
            grad[SLOTS] = e.sum()
            grad[SLOTS + 1] = 0
            used = np.flatnonzero(grad)
            grad[used] += 2e-5 * w[used]
            g[used] += grad[used] ** 2
            w[used] -= 0.25 * grad[used] / np.sqrt(g[used])
    return w


def score(w: np.ndarray, slots: list[list[int]]) -> list[float]:
    return [float(1 / (1 + np.exp(-min(30.0, max(-30.0, w[s].sum() + w[SLOTS]))))) for s in slots]


#: Different texts that must end in the same two words for these to count as a way to end.
ALIKE = 8


def _with_words(rows: DataFrame, words: DataFrame, pairs: DataFrame, spread: DataFrame) -> DataFrame:
    """The rows with the features that the whole corpus gives: of their last words, and of texts that many sources have."""
    # texts without words are many: they are put in behind the joins
    lower = F.when(F.rtrim("word") != "", F.rtrim("word"))
    joined = rows.drop("n", "ends").withColumn("lower", lower).withColumn("pair", F.when(F.col("pair") != "", F.col("pair")))
    joined = joined.join(words.select(F.col("word").alias("lower"), "n", "ends"), "lower", "left").join(pairs, "pair", "left").join(spread, "h", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = [s + _slots(_word_features(n, e, w.endswith(" "), bool(c), bool(z), k)) for s, w, n, e, c, z, k in zip(*[b.column(i).to_pylist() for i in range(3, 10)], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(slots, pa.list_(pa.int32()))], ["doc_id", "h", "label", "slots"])

    return joined.select("doc_id", "h", "label", "slots", "word", "n", "ends", "common", "closed", "alike").mapInArrow(run, "doc_id bigint, h bigint, label int, slots array<int>")


def scored(df: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, source and score, the probability that the stored text was cut off.

    df has doc_id, text, source and doc_kind; others are not read. Null, empty and blank texts have
    score 0; copies of a text have the highest score of any; a text that SURELY sources or more have in
    this very form has score 0; a null source has no limits, a null doc_kind is one of its own; repeated
    rows are scored each for itself. Without any text that can be cut nothing is taken for cut. sample:
    texts on which the classifier is fitted. The texts are read twice: for their lengths, and for all else.
    """
    docs = df.select(F.col("doc_id").cast("bigint"), "text", "source", "doc_kind")
    full = F.coalesce(F.col("text").rlike(NOT_BLANK), F.lit(False))
    lengths = written(docs.select("doc_id", "source", F.length("text").alias("n"), F.octet_length("text").alias("b"), F.when(full, F.xxhash64("text")).alias("h")))
    there = lengths.where("h is not null")
    piled = written(limits(there))
    everywhere = [tuple(r) for r in piled.select(F.lit("chars"), F.explode("chars")).union(piled.select(F.lit("octets"), F.explode("octets"))).distinct().orderBy("chars", "col").collect()]
    sources = written(there.select("h", "source").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= COMMON))
    spread = sources.select("h", F.lit(True).alias("common"))
    total = there.select("h").distinct().count()
    share = min(1_000_000, int(1_000_000 * sample / max(1, total)) + 1)
    rows = written(_read(docs.where(full).withColumn("h", F.xxhash64("text")).join(piled, "source", "left"), share, everywhere))
    stored, lessons = rows.where(F.col("label") == STORED), rows.where(F.col("label").isin(INTACT, CUT)).dropDuplicates(["h", "label"])
    asked = rows.where(F.col("label") != WORD).select(F.rtrim("word").alias("word")).where("word <> ''").distinct()
    words = written(rows.where(F.col("label") == WORD).groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).join(asked, "word", "left_semi"))
    # two words that end many different texts, and most of those that have the second word at their end
    endings = stored.where("pair <> ''").groupBy("pair", F.rtrim("word").alias("last")).agg(F.approx_count_distinct("h", 0.02).alias("alike"))
    most = endings.groupBy("last").agg(F.sum("alike").alias("all"))
    pairs = written(endings.where(F.col("alike") >= ALIKE).join(most, "last").where(F.col("alike") * 2 >= F.col("all")).select("pair", "alike"))
    taught = _with_words(lessons, words, pairs, spread).orderBy("h", "label").limit(3 * sample).toArrow()
    slots, labels, marks = taught.column("slots").to_pylist(), (np.asarray(taught.column("label")) == CUT).astype(np.int64), np.asarray(taught.column("h"))
    w = np.zeros(SLOTS + 2)
    w[SLOTS] = -30
    if len(slots) and labels.any():
        w = fit(slots, labels)
        natural = {zlib.crc32(f"like{k}".encode()) % SLOTS for k in range(1, 5)}
        doubtful = {int(h) for h, x, s, y in zip(marks, slots, score(w, slots), labels, strict=True) if not y and s > 0.5 and natural.isdisjoint(x)}
        keep = np.array([int(h) not in doubtful for h in marks])  # neither the text nor what was cut from it
        w = fit([s for s, k in zip(slots, keep, strict=True) if k], labels[keep])
    weights = df.sparkSession.sparkContext.broadcast(w.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score(weights.value, b.column(3).to_pylist()), pa.float64())], ["doc_id", "h", "score"])

    each = _with_words(stored, words, pairs, spread).mapInArrow(run, "doc_id bigint, h bigint, score double")
    best = each.groupBy("h").agg(F.max("score").alias("score")).join(sources.where(F.col("m") >= SURELY).select("h"), "h", "left_anti")
    return lengths.join(best, "h", "left").select("doc_id", "source", F.coalesce("score", F.lit(0.0)).alias("score"))


def rates(of: DataFrame, sure: float = 0.5) -> DataFrame:
    """Texts, cut texts and their share per source."""
    return of.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("score") >= sure).alias("n_cut"), F.round(F.count_if(F.col("score") >= sure) / F.count(F.lit(1)), 6).alias("rate"))
