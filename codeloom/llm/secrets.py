"""Problem 2: credentials written out in source code and configuration.

Literals in the place or shape of a credential are indexed over the whole corpus. Those that many
owners share are placeholders and are suppressed, unless they have a service's shape; rare ones are confirmed. An automaton of the
confirmed values then reads every text again, so that a secret is also found where nothing beside
its value gives it away. Redaction replaces the value only, by something of the same form.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.base import written

#: A value with at least so many owners, and this share of all repositories, is a placeholder.
OWNERS, SHARE = 6, 0.03
#: Characters of confirmed values in one automaton; more are looked up by their ends.
AUTOMATON = 16_000_000
#: A value of fewer characters is no credential unless it is found in a place that only credentials have (a URL, a manifest, a key block).
LEAST = 6
#: Bits of the filter of ends of values that is broadcast where these are too many for one automaton.
FILTER = 1 << 27
#: A value of fewer characters is searched for again only if it is telling.
SHORT = 12

# Words at the end of a name that mean a credential, and those that make "key" mean one.
_CREDENTIAL = {"password", "passwd", "pwd", "pass", "pw", "passphrase", "passcode", "secret", "secrets", "token", "credential", "credentials", "cred", "creds", "auth", "apikey", "secretkey", "accesskey", "privatekey", "authtoken", "accesstoken", "clientsecret"}
_KEYS = {"api", "signing", "session", "service", "login", "host", "private", "access", "secret", "encryption", "master", "account", "auth", "client", "deploy", "ssh", "shared", "webhook", "admin", "user", "app", "application", "storage", "consumer", "license", "security", "crypt", "server", "tls", "ssl", "rsa", "jwt", "hmac", "bot", "root"}
_PLACEHOLDER = re.compile(
    r"(?i)^(?:|\$.*|<.*>|\{\{.*|%[({].*|@\{.*|#\{.*|__\w+__|\*+|x{4,}.*|\.{3,}|-+|your[-_ ].*|my[-_ ].*|replace[-_ ]?.*|change[-_ ]?(?:me|it).*|.*(?:placeholder|redacted|example|dummy|sample|changeme|to-?do|insert[-_ ]|todo).*"
    r"|null|none|nil|true|false|undefined|test|secret|password|token|vault:.*|ref\+.*|enc\[.*|env[:.(\[].*|os\.(?:environ|getenv).*|process\.env.*|system\.getenv.*|!vault.*|arn:.*|file:.*|/[\w./-]+|\w+\(.*)$"
)
#: Shapes that services give their credentials, by how they begin: what follows that.
_SHAPES = {
    "gh[opsur]_": "[A-Za-z0-9]{20,}", "github_pat_": r"\w{30,}", "glpat-": r"[\w-]{16,}", "npm_": "[A-Za-z0-9]{30,}", "(?:AKIA|ASIA)": "[A-Z0-9]{16}(?![A-Za-z0-9])", "xox[abprs]-": r"[\w-]{10,}", "[sr]k_(?:live|test)_": "[A-Za-z0-9]{16,}",
    r"SG\.": r"[\w-]{16,}\.[\w-]{30,}", "eyJ": r"[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}", "pypi-": r"[\w-]{40,}", "AIza": r"[\w-]{35}", "hf_": "[A-Za-z0-9]{30,}", "sq0": r"[a-z]{3}-[\w-]{22,}", "key-": "[0-9a-f]{32}",
    "[a-z]{3,16}_": "(?=[A-Za-z]*\\d)(?=[a-z0-9]*[A-Z])(?=[A-Z0-9]*[a-z])[A-Za-z0-9]{32}(?![A-Za-z0-9_])",
}
#: The same, after whatever character can't be part of one.
_STRUCTURED = re.compile(r"(?<![A-Za-z0-9_/+-])(?:" + "|".join(a + b for a, b in _SHAPES.items()) + ")")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+://[^\s/:@\"'`<>]*+:([^\s@\"'`]++)@")
_HEADER = re.compile(r"(?i)\b(?:authorization|proxy-authorization|x-api-key|x-auth-token)[\"']?\s*[:=,]\s*[\"'`]?(?:(?:bearer|basic|token|digest|apikey)\s+)?([^\s\"'`,;]{6,})|\b(?:bearer|basic)\s+([A-Za-z0-9+/=._~-]{16,})")
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?=\s*\Z)|(?:\\n|\\r|[\s\"'+\\#/*>|])*[A-Za-z0-9+/=]{8,}(?:[\s\S]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|(?:\\n|[A-Za-z0-9+/=\s])*))")
#: Something that ends like a credential's name, and what stands between a name and its value.
_NAMED = re.compile(r"(?i)((?:passw(?:or)?d|pwd|pass|pw|passphrase|passcode|secrets?|token|key|cred(?:ential)?s?|auth)(?:[_-]?\d+)?)([\"'`\]]{0,2}[ \t]*(?::[ \t]*[A-Za-z]\w*[ \t]*(?==[^=>]))?(?::=|=>|=(?!=)|:(?!:)|,(?=[ \t]*[\"'])|(?<=\w)[ \t]+(?=[\"']|(?:was|is|as)[ \t]))(?:[ \t]*(?:was|is|as)[ \t]+)?[ \t]*)")
_TERRAFORM = re.compile(r"variable\s+\"([\w-]+)\"\s*\{[^{}]*?\bdefault\s*=\s*\"([^\"\n]*)\"")
_XML = re.compile(r"<([\w.:-]+)>([^<>\s]{4,})</\1>")
_LITERAL = re.compile(r"[rRbBuUfF]{0,2}(\"\"\"|'''|\"|'|`)")
_MORE = re.compile(r"\s*(?:\+|\.(?=\s*[\"'])|\\\n|\n)?\s*[rRbBuUfF]?([\"'`])")
_BARE = re.compile(r"[^\s\"'`,;()\[\]{}<>]+")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_CONFIG = re.compile(r"(?i)\.(?:env|ini|ya?ml|properties|toml|conf|cfg|sh|bash|zsh|md|txt|json|tf|tfvars)$|(?:^|/)(?:dockerfile|makefile|\.env[.\w]*|\.npmrc|\.netrc)$")
_SECRET_KIND = re.compile(r"(?m)^[ \t]*kind:[ \t]*[\"']?Secret[\"']?[ \t]*\r?$")
_DATA = re.compile(r"(?m)^([ \t]*)data:[ \t]*\r?$\n?")


class Hit(NamedTuple):
    line_no: int
    start: int
    end: int
    value: str
    kind: str  # named, shape, url, header, block or data; again if only the value tells
    more: str  # where further pieces of the value stand: "start-end,..."


def credential(name: str) -> bool:
    """Whether a name is that of a credential: judged by its last words, a number at its end aside."""
    flag = name.startswith("-")
    words = [w.lower() for w in _WORD.findall(name)]
    if not words:
        return False
    if words[-1] in _CREDENTIAL:
        return "public" not in words
    return words[-1] == "key" and (words[-2] in _KEYS if len(words) > 1 else flag)


def placeholder(value: str) -> bool:
    return bool(_PLACEHOLDER.match(value.strip()))


def telling(value: str) -> bool:
    """Whether a value by its characters can be a credential: more than words."""
    if len(value) < LEAST or any(c.isspace() for c in value) or placeholder(value) or "${" in value or "{{" in value:
        return False
    return any(c.isdigit() for c in value) or (any(c.isupper() for c in value[1:]) and any(c.islower() for c in value)) or any(c in "!#$%^&*+=?@~" for c in value)


def _literal(text: str, at: int) -> tuple[str, int, int, list[tuple[int, int]]] | None:
    """The string literal at an offset with the pieces joined to it: value, start and end of the first piece, other pieces."""
    m = _LITERAL.match(text, at)
    if not m:
        return None
    quote, start = m[1], m.end()
    end = _closing(text, start, quote)
    if end < 0:
        return None
    value, rest, at = text[start:end], [], end + len(quote)
    while len(quote) == 1 and (n := _MORE.match(text, at)) and (close := _closing(text, n.end(), n[1])) >= 0:
        if not n.group()[:-1].strip("rRbBuUfF \t\r\n\\"):  # side by side: only pieces in brackets or on one line belong together
            if "\n" in n.group():
                break
        value += text[n.end() : close]
        rest.append((n.end(), close))
        at = close + 1
    return value, start, end, rest


def _closing(text: str, at: int, quote: str) -> int:
    """The offset of the quote that ends a literal of one line (or of several, for triple quotes), or -1."""
    while True:
        end = text.find(quote, at)
        if end < 0 or (len(quote) == 1 and "\n" in text[at:end] and quote != "`"):
            return -1
        slashes = len(text[:end]) - len(text[max(0, end - 20) : end].rstrip("\\")) - max(0, end - 20)
        if slashes % 2 == 0:
            return end
        at = end + 1


def hits(text: str, path: str) -> list[Hit]:
    """The candidates of a text, one for each place, in order."""
    found: dict[int, Hit] = {}
    config = bool(_CONFIG.search(path or ""))

    def add(start: int, end: int, value: str, kind: str, rest: list[tuple[int, int]] | None = None) -> None:
        if start not in found:
            found[start] = Hit(text.count("\n", 0, start) + 1, start, end, value, kind, ",".join(f"{a}-{b}" for a, b in rest or []))

    blocks = []
    for m in _BLOCK.finditer(text):
        blocks.append(m.span())
        add(m.start(), m.end(), m.group(), "block")
    for doc in _documents(text):
        for start, end, value in _data(text, *doc):
            if not any(a <= start < b for a, b in blocks):
                add(start, end, value, "data")
    taken = [h[1:3] for h in found.values()]
    for m in _URL.finditer(text):
        if not placeholder(m[1]) and "${" not in m[1] and "{{" not in m[1] and not re.search(r"[<>{}]", m[1]):
            add(m.start(1), m.end(1), m[1], "url")
    for m in _HEADER.finditer(text):
        g = 1 if m[1] else 2
        if telling(m[g]) and m[g].lower() not in ("bearer", "basic"):
            add(m.start(g), m.end(g), m[g], "header")
    for m in _TERRAFORM.finditer(text):
        if credential(m[1]) and telling(m[2]):
            add(m.start(2), m.end(2), m[2], "named")
    for m in _XML.finditer(text):
        if credential(m[1]) and telling(m[2]):
            add(m.start(2), m.end(2), m[2], "named")
    for m in _NAMED.finditer(text):
        at = m.start()
        while at and (text[at - 1].isalnum() or text[at - 1] in "_$.-"):
            at -= 1
        name = text[at : m.start()] + m[1]
        if not credential(name):
            continue
        at = m.end()
        if text.startswith("(", at):  # pieces in brackets
            at = re.compile(r"\(\s*").match(text, at).end()  # type: ignore[union-attr]
        lit = _literal(text, at)
        if lit:
            if telling(lit[0]) and "-----BEGIN" not in lit[0] and "://" not in lit[0]:
                add(lit[1], lit[2], lit[0], "named", lit[3])
            continue
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        if (config or name.startswith("-") or re.search(r"(?:^|\s)(?:#|//|\*|--)", line) or line.lstrip().startswith("*")) and (b := _BARE.match(text, at)):
            value = b.group().rstrip(".") if not config else b.group()
            if telling(value) and "://" not in value and not re.fullmatch(r"[\w.]+\.[A-Za-z_]\w*", value):
                add(b.start(), b.start() + len(value), value, "named")
    for m in _STRUCTURED.finditer(text):
        if not placeholder(m.group()) and not any(h.start <= m.start() < h.end for h in found.values() if h.kind != "named" or h.start != m.start()):
            add(m.start(), m.end(), m.group(), "shape")
    # what lies within a key block or a value of a manifest belongs to it
    return [h for s, h in sorted(found.items()) if not any(a < s < b or (a == s and (a, b) != (h.start, h.end)) for a, b in taken)]


def _documents(text: str) -> Iterator[tuple[int, int]]:
    """The YAML documents of kind Secret."""
    if _SECRET_KIND.search(text):
        at = 0
        for m in re.finditer(r"(?m)^---[^\n]*$|\Z", text):
            if _SECRET_KIND.search(text, at, m.start()):
                yield at, m.start()
            at = m.end()


def _data(text: str, low: int, high: int) -> Iterator[tuple[int, int, str]]:
    for d in _DATA.finditer(text, low, high):
        depth, at, scalar = len(d[1]), d.end(), None
        while at < high:
            end = text.find("\n", at, high)
            end = high if end < 0 else end
            line = text[at:end].rstrip("\r")
            indent = len(line) - len(line.lstrip(" \t"))
            if line.strip():
                if indent <= depth:
                    break
                if scalar is not None and indent > scalar:
                    if scalar_open:  # the first line of a block's text
                        scalar_open = False
                        value = line.strip()
                        if not placeholder(value):
                            yield at + indent, at + len(line.rstrip()), value
                else:
                    scalar = None
                    m = re.match(r"\s*(?:[\"']?)[\w.$/-]+(?:[\"']?):[ \t]*(.*)", line)
                    if m:
                        value = m[1].split(" #")[0].strip()
                        if value[:1] in "|>" and len(value) < 3:
                            scalar, scalar_open = indent, True
                        else:
                            inner = value.strip("\"'")
                            if inner and not placeholder(inner):
                                start = at + m.start(1) + m[1].index(inner)
                                yield start, start + len(inner), inner
            at = end + 1


#: What a text must hold to have a candidate, for the JVM to tell.
HINT = r"(?i)passw|pwd|pass|pw|secret|token|key|cred|auth|bearer|basic|://[^\s/]*:[^\s]*@|" + "|".join(a + ("[A-Za-z0-9]{32}" if a == "[a-z]{3,16}_" else "") for a in _SHAPES)

SCHEMA = "row_id bigint, line_no int, start int, end int, value string, kind string, more string"


def _batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [[]] * 7
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["row_id", "line_no", "start", "end", "value", "kind", "more"])


def index(df: DataFrame) -> DataFrame:
    """Every literal of df's texts in the place or shape of a credential."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for row, path, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                out += [(row, *h) for h in hits(text, path)]
            yield _batch(out)

    texts = df.where(F.col("chunk_text").rlike(HINT)).select(F.col("row_id").cast("bigint"), "file_path", "chunk_text")
    return texts.mapInArrow(run, SCHEMA)


def _key_lines(block: str) -> Iterator[str]:
    """The lines of a key block's body, and all of them as one."""
    body = re.sub(r"-----[^-]*-----", "\n", re.sub(r"\\[nr]", "\n", block))
    lines = [m[1] for x in body.split("\n") if (m := re.fullmatch(r"(?:[\s\"'`+\\#/*>|]*[\s\"'`\\#*>|])?([A-Za-z0-9+/=]+)(?:[\s\"'`\\,;)][\s\"'`+\\,;)]*)?", x))]
    # what has no end may run on into other text, which is no key
    least = SHORT if "-----END" in block else 40
    lines += ["".join(lines)] if len(lines) > 1 and least == SHORT else []
    yield from (x for x in lines if len(x) >= least and telling(x))


def searched(value: str, kind: str) -> set[tuple[str, str]]:
    """What is searched for of a confirmed value, and the kind of what is found so.

    Of a key the lines of its body; of a manifest's value the code and what it stands for. Few
    characters must look like a credential by themselves, since they may be a word.
    """
    if kind == "block":
        return {(x, "again") for x in _key_lines(value)}
    out = {(value, "data" if kind == "data" else "again")} if "-----BEGIN" not in value else set()
    if kind == "data":
        try:
            plain = base64.b64decode(value, validate=True).decode().strip()
        except ValueError:
            plain = ""
        inner = hits(plain, ".env")
        out |= {x for h in inner if h.kind != "data" for x in searched(h.value, h.kind)}
        # manifests also hold plain words, which stand elsewhere in their own right
        if "-----BEGIN" not in plain and any(telling(x) for x in plain.split()):
            out.add((plain, "again"))
    return {(w, k) for w, k in out if len(w) >= SHORT or telling(w)}


def _words(confirmed: DataFrame) -> DataFrame:
    """value and kind of all that is searched for, each value once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = sorted({x for v, k in zip(*[c.to_pylist() for c in b.columns], strict=True) for x in searched(v, k)})
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([k for _, k in out], pa.string())], ["value", "kind"])

    return confirmed.select("value", "kind").distinct().mapInArrow(run, "value string, kind string").groupBy("value").agg(F.min("kind").alias("kind"))


def _apart(text: str, start: int, end: int) -> bool:
    """Whether what stands there is no part of a longer word."""
    return not (start and text[start - 1].isalnum()) and not text[end : end + 1].isalnum()


def _rescan(df: DataFrame, values: DataFrame) -> DataFrame:
    """Where the values stand in df's texts, whatever stands around them; each text is read once.

    Values of together up to AUTOMATON characters make one automaton that is broadcast. Of more, a
    filter of a fixed number of bits is broadcast, which tells the places where the last characters
    of some value may stand. Only these places are shuffled to the values with the same last
    characters, of which each group of texts and values makes an automaton of its own.
    """
    size = values.agg(F.sum(F.length("value"))).first()[0] or 0
    texts = df.where("chunk_text is not null").select(F.col("row_id").cast("bigint"), "chunk_text")
    if not size:
        return df.sparkSession.createDataFrame([], SCHEMA)
    return _scan_all(texts, values) if size <= AUTOMATON else _scan_parts(texts, values)


def _automaton(words: Iterable[tuple[str, str]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for w, kind in words:
        automaton.add_word(w, (w, kind))
    automaton.make_automaton()
    return automaton


def _occurrences(automaton: ahocorasick.Automaton, row: int, text: str) -> Iterator[tuple]:
    for last, (w, kind) in automaton.iter(text):
        start, end = last - len(w) + 1, last + 1
        if _apart(text, start, end):
            yield row, text.count("\n", 0, start) + 1, start, end, w, kind, ""


def _scan_all(texts: DataFrame, values: DataFrame) -> DataFrame:
    words = texts.sparkSession.sparkContext.broadcast([c.to_pylist() for c in values.select("value", "kind").toArrow().columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(zip(*words.value, strict=True))
        for b in batches:
            yield _batch([x for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in _occurrences(automaton, row, text)])

    return texts.mapInArrow(run, SCHEMA)


def _ends(text: str) -> tuple[np.ndarray, np.ndarray]:
    """For each place where a value may end, which is no place within a word: the offset behind it, and a hash of the LEAST characters before."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - LEAST + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(LEAST):
        h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    word = np.fromiter((c.isalnum() for c in text), bool, len(text))
    at = np.flatnonzero(~np.append(word[LEAST:], False))
    return at + LEAST, h[at]


def _scan_parts(texts: DataFrame, values: DataFrame) -> DataFrame:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [int(_ends(v)[1][-1].view(np.int64)) for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h, pa.int64())], ["value", "kind", "h"])

    ends = written(values.select("value", "kind").where(F.length("value") >= LEAST).mapInArrow(hashed, "value string, kind string, h bigint"))
    # the filter: words of 64 bits, those that have any set
    slot = F.pmod(F.col("h"), F.lit(FILTER))
    set_bits = ends.select((slot / 64).cast("bigint").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(h, {FILTER}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER // 64, np.uint64)
    bits[np.asarray(set_bits.column("word"))] = np.asarray(set_bits.column("bits")).view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            rows, ats, hs = [], [], []
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, h = _ends(text)
                slot = np.mod(h.view(np.int64), np.int64(FILTER)).astype(np.uint64)
                hit = (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
                rows += [row] * int(hit.sum())
                ats += at[hit].tolist()
                hs += h[hit].view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ats, pa.int32()), pa.array(hs, pa.int64())], ["row_id", "end", "h"])

    places = texts.mapInArrow(run, "row_id bigint, end int, h bigint")
    # values that end alike and lie where one may end: by their length the text tells which
    near = places.join(ends, "h").select("row_id", "end", "value", "kind")
    there = near.join(texts, "row_id").where((F.col("end") >= F.length("value")) & (F.col("chunk_text").substr(F.col("end") - F.length("value") + 1, F.length("value")) == F.col("value")))
    start = F.col("end") - F.length("value")
    whole = there.where((start == 0) | ~F.col("chunk_text").substr(start, F.lit(1)).rlike(r"[\p{L}\p{N}]"))
    line = F.length(F.col("chunk_text").substr(F.lit(1), start)) - F.length(F.replace(F.col("chunk_text").substr(F.lit(1), start), F.lit("\n"), F.lit("")))
    return whole.select("row_id", (line + 1).cast("int").alias("line_no"), start.cast("int").alias("start"), "end", "value", "kind", F.lit("").alias("more")).distinct()


def find(df: DataFrame, owners: int = OWNERS) -> DataFrame:
    """row_id, line_no, start, end, value, kind and more of the credentials in df's chunk_text.

    df has row_id, repo_id, file_path and chunk_text; others are not read. line_no is counted inside
    the text, start and end are offsets of its characters, more the places of further pieces. Null
    and empty texts have none; rows of one row_id are judged each for itself; null repo_id counts
    as one owner. An empty table gives no rows. Values with many owners are placeholders (at least
    owners, and SHARE of all repositories), except in the shapes of services; copies of one text have
    one owner, but a text that more than half of all repositories hold counts for each.
    """
    indexed = written(index(df))
    repos = df.select(F.coalesce("repo_id", F.lit("")).alias("repo_id")).distinct().count()
    counted = indexed.where("kind in ('named', 'shape', 'header')").where(~F.col("value").rlike(_STRUCTURED.pattern))
    owned = counted.select("row_id", "value").join(df.select(F.col("row_id").cast("bigint"), F.coalesce("repo_id", F.lit("")).alias("repo_id"), F.sha2("chunk_text", 256).alias("text")), "row_id")
    # copies of one text have one owner, unless most repositories hold it
    texts = owned.select("value", "text", "repo_id").distinct().groupBy("value", "text").agg(F.min("repo_id").alias("owner"), F.count(F.lit(1)).alias("holders"))
    counts = texts.groupBy("value").agg(F.count_distinct("owner").alias("n"), F.max("holders").alias("holders"))
    most = F.greatest(F.lit(owners), F.ceil(F.lit(SHARE * repos)))
    shared = counts.where((F.col("n") >= most) | ((F.col("holders") >= owners) & (F.col("holders") * 2 > repos))).select("value")
    confirmed = written(indexed.join(shared.withColumn("shared", F.lit(True)), "value", "left").where("shared is null or kind in ('url', 'block', 'data')").select(*indexed.columns))
    again = _rescan(df, written(_words(confirmed)))
    place = ["row_id", "start"]
    # what lies within a confirmed value, such as a line of a key, is that value
    known = confirmed.select("row_id", F.col("start").alias("from"), F.col("end").alias("to"))
    again = again.join(known, (again["row_id"] == known["row_id"]) & ((again["start"] == known["from"]) | ((again["start"] >= known["from"]) & (again["end"] <= known["to"]))), "left_anti").groupBy(*place).agg(*[F.max_by(F.struct("line_no", "end", "value", "kind", "more"), "end").alias("h")]).select("row_id", "h.line_no", "start", "h.end", "h.value", "h.kind", "h.more")
    return confirmed.unionByName(again)


def redact(df: DataFrame, owners: int = OWNERS) -> DataFrame:
    """row_id and chunk_text of the rows with credentials, each of these replaced and nothing else.

    In place of a value of a manifest stands the code of the same word, so that it still decodes; of a value in
    pieces the first is replaced and the others are emptied, so that the pieces still join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, spots in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                cuts = {}
                for s in spots:
                    word = "REDACTED"
                    if s["kind"] == "data" and not s["value"].startswith("-----"):
                        word = base64.b64encode(word.encode()).decode()
                    cuts[s["start"]] = (s["end"], word)
                    for piece in filter(None, s["more"].split(",")):
                        a, z = map(int, piece.split("-"))
                        cuts[a] = (z, "")
                out, at = [], 0
                for start in sorted(cuts):
                    end, word = cuts[start]
                    if start >= at:
                        out.append(text[at:start] + word)
                    at = max(at, end)
                texts.append("".join(out) + text[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row_id", "chunk_text"])

    spots = find(df, owners).groupBy("row_id").agg(F.collect_list(F.struct("start", "end", "value", "kind", "more")).alias("spots"))
    rows = df.select(F.col("row_id").cast("bigint"), "chunk_text").join(spots, "row_id")
    return rows.mapInArrow(run, "row_id bigint, chunk_text string")
