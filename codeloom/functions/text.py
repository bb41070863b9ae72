"""Scalar functions over texts: identities, counts, cleaning, redaction, extraction from HTML and Markdown."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short_hash(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def repo_id(path_or_url: Column, branch: Column) -> Column:
    return short_hash(F.concat_ws("::", path_or_url, branch))


def chunk_id(repo: Column, text: Column) -> Column:
    """Of the text before any header is put before it."""
    return F.concat_ws("_", repo, short_hash(text))


def symbol_id(repo: Column, path: Column, kind: Column, name: Column) -> Column:
    return short_hash(F.concat_ws(":", repo, path, kind, name), 20)


def graph_id(repo: Column, path: Column | None = None, kind: str = "repo", owner: Column | None = None, name: Column | None = None) -> Column:
    """repo:r, file:r:p, class:r:p:C, func:r:p:C.f or func:r:p:f."""
    if path is None:
        return F.concat(F.lit("repo:"), repo)
    if name is None:
        return F.concat_ws(":", F.lit("file"), repo, path)
    whole = F.concat_ws(".", owner, name) if owner is not None else name
    return F.concat_ws(":", F.lit(kind), repo, path, whole)


def node_id(*parts: Column) -> Column:
    """Parts without outer _ and . joined by _, other characters than letters and digits made _, in lower case."""
    bare = [F.regexp_replace(p, r"^[_.]+|[_.]+$", "") for p in parts]
    joined = F.array_join(F.filter(F.array(*bare), lambda p: p != ""), "_")
    return F.lower(F.regexp_replace(F.regexp_replace(joined, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))


def words(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.size(words(text)))


def tokens(text: Column) -> Column:
    """An estimate, four characters a token."""
    return F.floor(F.length(text) / 4).cast("bigint")


def truncate_to_tokens(text: Column, n: int) -> Column:
    return F.substring(text, 1, 4 * n)


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def label(text: Column, most: int = 256) -> Column:
    """Without control characters, cut to most characters."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x1f\x7f]", ""), 1, most)


def file_name(url: Column, most: int = 80) -> Column:
    """Host and path of a URL as a safe name."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"[?#].*$", "")
    return F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[^A-Za-z0-9_-]", "_"), r"_+", "_"), r"^_+|_+$", ""), 1, most)


def url_type(url: Column) -> Column:
    """The first that fits of tweet, arxiv, github, youtube, pdf, image and webpage."""
    low = F.lower(url)
    bare = F.regexp_replace(low, r"[?#].*$", "")
    has = lambda *xs: low.rlike("|".join(x.replace(".", r"\.") for x in xs))
    return (
        F.when(has("twitter.com", "x.com"), "tweet").when(has("arxiv.org"), "arxiv").when(has("github.com"), "github").when(has("youtube.com", "youtu.be"), "youtube")
        .when(bare.endswith(".pdf"), "pdf").when(bare.rlike(r"\.(png|jpg|jpeg|webp|gif)$"), "image").otherwise("webpage")
    )


def allowed_url(url: Column) -> Column:
    """Scheme http or https, and no host of a private network or of instance metadata."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^@/]*@)?\[?([^/:?#\]]+)", 1))
    private = host.rlike(r"^(localhost|metadata\.google\.internal|metadata|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.|::1$|f[cd][0-9a-f]{2}:|fe80:)")
    return F.lower(url).rlike(r"^https?://") & (host != "") & ~private


def html_text(html: Column, most: int = 8000) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    return F.substring(trim_all(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]+>", " "), r"\s+", " ")), 1, most)


def html_title(html: Column, default: Column) -> Column:
    title = trim_all(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.coalesce(F.when(title != "", title), default)


def front_matter(markdown: Column) -> Column:
    return F.regexp_extract(markdown, r"^---[ \t]*\r?\n([\s\S]*?)\r?\n---", 1)


def without_front_matter(markdown: Column) -> Column:
    return F.regexp_replace(markdown, r"^---[\s\S]*?\n---[ \t]*\r?\n?", "")


def section(markdown: Column, heading: str) -> Column:
    """The text under a heading of level two, up to the next one."""
    return trim_all(F.regexp_extract(markdown, rf"(?m)^##[ \t]+{heading}[ \t]*\r?$\n([\s\S]*?)(?=^##[ \t]|\z)", 1))


def code_blocks(markdown: Column) -> Column:
    return F.regexp_extract_all(markdown, F.lit(r"(?s)```[A-Za-z0-9_+-]*\r?\n(.*?)```"), 1)


def bullets(markdown: Column) -> Column:
    return F.regexp_extract_all(markdown, F.lit(r"(?m)^[ \t]*[-*][ \t]+(.+?)[ \t]*\r?$"), 1)


# Signs of an academic paper, of which three suffice.
PAPER = (r"\barxiv\b", r"\bdoi\s*:", r"\babstract\b", r"\bproceedings\b", r"\bjournal\b", r"\bpreprint\b", r"\\cite\{", r"\[\d+\]", r"\[\n\d+\n\]", r"eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"\bwe propose\b", r"\bliterature\b")


def paper_signs(text: Column) -> Column:
    """How many of the signs the first 3,000 characters hold."""
    head = F.substring(text, 1, 3000)
    total = F.lit(0)
    for p in PAPER:
        total = total + head.rlike("(?i)" + p).cast("int")
    return total


# What redaction looks for, in this order, and the tags it leaves.
TAGGED = (
    ("PHONE_INTL", r"\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b"),
    ("IP_ADDRESS", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("MAC_ADDRESS", r"\b([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"),
    ("EMAIL_ADDRESS", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z]{2,}(?:\.[a-zA-Z]{2,})*"),
    ("PHONE_NUMBER", r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:\d{4}[ -]?){3}\d{4}\b"),
    ("DATE_OF_BIRTH", r"\b(?:0[1-9]|1[0-2])[/\-](?:0[1-9]|[12]\d|3[01])[/\-](?:19|20)\d{2}\b"),
    ("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]{0,18})\b"),
    ("AWS_ACCESS_KEY", r"(?:^|[^A-Z0-9])(?<key>AKIA[0-9A-Z]{16})(?:$|[^A-Z0-9])"),
    ("AWS_SECRET_KEY", r"(?i)aws_secret_access_key\s*[=:]\s*['\"]?([a-zA-Z0-9/+=]{40})['\"]?"),
    ("AWS_KEY_CONFIG", r"(?i)aws_access_key_id\s*=\s*[a-zA-Z0-9]{20}"),
    ("AZURE_STORAGE_KEY", r"(?i)(AccountKey|storage[_-]?key)\s*[=:]\s*['\"]?([a-zA-Z0-9+/]{86}==)['\"]?"),
    ("AZURE_CONN_STR", r"(?i)DefaultEndpointsProtocol=https?;AccountName=[^;]+;AccountKey=[a-zA-Z0-9+/]{86}==(?:;[^;]*)?"),
    ("GCP_KEY", r"(?i)(private_key_id|client_id)\s*[=:]\s*['\"]?([a-z0-9]{40})['\"]?"),
    ("JWT_TOKEN", r"eyJ[a-zA-Z0-9_=]+\.[a-zA-Z0-9_=]+\.[a-zA-Z0-9_\-\+=]+"),
    ("GITHUB_TOKEN", r"\b(ghp_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9_]{82})\b"),
    ("GITLAB_TOKEN", r"\b(glpat-[a-zA-Z0-9\-]{20,})\b"),
    ("SLACK_TOKEN", r"\b(xox[bpras]-[a-zA-Z0-9\-]{10,})\b"),
    ("SLACK_WEBHOOK", r"https://hooks\.slack\.com/services/T[A-Za-z0-9]+/B[A-Za-z0-9]+/[a-zA-Z0-9]+"),
    ("STRIPE_KEY", r"\b(sk_live_[a-zA-Z0-9]{24,}|pk_live_[a-zA-Z0-9]{24,}|sk_test_[a-zA-Z0-9]{24,}|pk_test_[a-zA-Z0-9]{24,})\b"),
    ("TWILIO_KEY", r"\b(SK[a-f0-9]{32})\b"),
    ("SENDGRID_KEY", r"\bSG\.[a-zA-Z0-9_\-]{22}\.[a-zA-Z0-9_\-]{43}\b"),
    ("NPM_TOKEN", r"\b(npm_[a-zA-Z0-9]{36})\b"),
    ("PYPI_TOKEN", r"\b(pypi-[a-zA-Z0-9\-]{50,})\b"),
    ("HEROKU_KEY", r"(?i)heroku\s*[_-]?api[_-]?key\s*[=:]\s*['\"]?([a-f0-9\-]{36})['\"]?"),
    ("MAILCHIMP_KEY", r"\b[a-f0-9]{32}-us\d{1,2}\b"),
    ("SQUARE_TOKEN", r"\b(sq0[a-z]{3}-[a-zA-Z0-9\-_]{22,})\b"),
    ("PRIVATE_KEY", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    ("CERTIFICATE", r"-----BEGIN CERTIFICATE-----[\s\S]*?-----END CERTIFICATE-----"),
    ("HEX_SECRET", r"(?i)(?:secret|password|token|key|credential|auth)[\s_]*[=:]\s*['\"]?([a-f0-9]{32,})['\"]?"),
    ("PASSWORD_FIELD", r"(?i)(password|passwd|pwd|pass)\s*[=:]\s*['\"]?([^\s'\"]{4,})['\"]?"),
    ("DOCKER_AUTH", r"(?i)(auth)\s*[=:]\s*['\"]?([A-Za-z0-9+/]{20,}={0,2})['\"]?"),
    ("K8S_SECRET", r"(?i)(data:\s*\n(?:\s+[a-zA-Z0-9_.-]+:\s*[A-Za-z0-9+/]{16,}={0,2}\s*\n?)+)"),
    ("TERRAFORM_SECRET", r"(?i)(variable\s+\"[^\"]*(?:password|secret|key|token)[^\"]*\"\s*\{[^}]*default\s*=\s*\")([^\"]+)(\")"),
)
# Passwords in URLs, keys by their names, and headers.
CONNECTION = r"(:\/\/[^:]+:)([^@\s]{4,})(@)"
API_KEYS = r"(?i)((api[_-]?key|apikey|secret[_-]?key|secretkey|access[_-]?token|bearer[_-]?token|auth[_-]?token|private[_-]?key|client[_-]?secret|app[_-]?secret|consumer[_-]?key|consumer[_-]?secret|signing[_-]?key|encryption[_-]?key|master[_-]?key|service[_-]?key|webhook[_-]?secret|shared[_-]?secret)\s*[:=]\s*['\"]?)([a-zA-Z0-9_\-\.]{16,})(['\"]?)"
BEARER = r"(?i)(Authorization\s*[:=]\s*Bearer\s+)([a-zA-Z0-9_\-\.]+)"
BASIC = r"(?i)(Authorization\s*[:=]\s*Basic\s+)([A-Za-z0-9+/]{16,}={0,2})"


# What a text, or its lower case, must hold for a pattern to be tried: any of some literals, or a simpler pattern. Tags hold
# none of them in a way that a later pattern could match, so that the text as it was first is asked.
HINTS = {
    "PHONE_INTL": ["+"], "IP_ADDRESS": r"\d\.\d{1,3}\.\d", "MAC_ADDRESS": r"[:-][0-9A-Fa-f]{2}[:-]", "EMAIL_ADDRESS": ["@"], "PHONE_NUMBER": r"\d{3}[-.\s]?\d{4}", "SSN": r"\d-\d\d-\d", "CREDIT_CARD": r"\d{4}[ -]?\d{4}",
    "DATE_OF_BIRTH": r"\d[/-]\d\d[/-]\d", "IBAN": r"\d{7}", "AWS_ACCESS_KEY": ["akia"], "AWS_SECRET_KEY": ["aws_secret"], "AWS_KEY_CONFIG": ["aws_access"], "AZURE_STORAGE_KEY": ["accountkey", "storage"],
    "AZURE_CONN_STR": ["defaultendpoints"], "GCP_KEY": ["private_key_id", "client_id"], "JWT_TOKEN": ["eyj"], "GITHUB_TOKEN": ["ghp_", "github_pat_"], "GITLAB_TOKEN": ["glpat-"], "SLACK_TOKEN": ["xox"], "SLACK_WEBHOOK": ["hooks.slack"],
    "STRIPE_KEY": ["k_live_", "k_test_"], "TWILIO_KEY": r"SK[a-f0-9]{8}", "SENDGRID_KEY": ["sg."], "NPM_TOKEN": ["npm_"], "PYPI_TOKEN": ["pypi-"], "HEROKU_KEY": ["heroku"], "MAILCHIMP_KEY": ["-us"], "SQUARE_TOKEN": ["sq0"],
    "PRIVATE_KEY": ["-----begin"], "CERTIFICATE": ["-----begin"], "HEX_SECRET": r"(?i)(?:secret|password|token|key|credential|auth)[\s_]*[=:]", "PASSWORD_FIELD": ["password", "passwd", "pwd", "pass"], "DOCKER_AUTH": r"(?i)auth\s*[=:]",
    "K8S_SECRET": ["data:"], "TERRAFORM_SECRET": ["variable"],
}


def _tried(hint: str | list[str], pattern: str, tag: str) -> Callable[[Column], Column]:
    def step(x: Column) -> Column:
        if isinstance(hint, str):
            there = x["first"].rlike(hint)
        else:
            there = F.contains(x["low"], F.lit(hint[0]))
            for h in hint[1:]:
                there = there | F.contains(x["low"], F.lit(h))
        return F.struct(F.when(there, F.regexp_replace(x["now"], pattern, tag)).otherwise(x["now"]).alias("now"), x["first"].alias("first"), x["low"].alias("low"))

    return step


# What is asked before some hints, since it is found faster: one pattern that each hint on digits implies, and words.
DIGITS = r"\d(?:\d\d[-.\s]?\d{4}|[/-]\d\d[/-]\d|\.\d{1,3}\.\d)"
OF_DIGITS = {"IP_ADDRESS", "PHONE_NUMBER", "SSN", "CREDIT_CARD", "DATE_OF_BIRTH", "IBAN"}
WORDS = {"HEX_SECRET": ["secret", "password", "token", "key", "credential", "auth"], "DOCKER_AUTH": ["auth"], "TWILIO_KEY": ["sk"]}


def _steps(bounded: bool) -> list[tuple[str | list[str], str, str]]:
    steps: list[tuple[str | list[str], str, str]] = [(["://"], CONNECTION, "$1<CONNECTION_PASSWORD>$3")]
    steps += [(HINTS[tag], p if bounded else ascii_bounds(p), f"<{tag}>") for tag, p in TAGGED]
    return steps + [(["key", "token", "secret"], API_KEYS, "$1<API_KEY>$4"), (["authorization"], BEARER, "$1<BEARER_TOKEN>"), (["authorization"], BASIC, "$1<BASIC_AUTH>")]


def redacted(df: DataFrame, column: str, bounded: bool = True) -> DataFrame:
    """df with a column of texts redacted, as by redact, which is for a single expression.

    Each step is a projection of its own, so that it names the text once and is compiled with the
    others into one stage; a null text stays null. Texts without a hint of any step pass them all by.
    """
    first, low, now, digits = (F.col(f"__{x}") for x in ("first", "low", "now", "digits"))
    out = df.withColumns({"__first": F.col(column), "__now": F.col(column), "__low": F.lower(column), "__digits": F.col(column).rlike(DIGITS)})
    holds = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in words])
    for hint, pattern, tag in _steps(bounded):
        there = holds(hint) if isinstance(hint, list) else first.rlike(hint)
        if tag[1:-1] in OF_DIGITS:
            there = digits & there
        elif tag[1:-1] in WORDS:
            there = holds(WORDS[tag[1:-1]]) & there
        out = out.withColumn("__now", F.when(there, F.regexp_replace(now, pattern, tag)).otherwise(now))
    return out.withColumn(column, now).drop("__first", "__low", "__now", "__digits")


def redact(text: Column, bounded: bool = True) -> Column:
    """Passwords in URLs, then the tagged patterns in their order, then keys by their names, then headers.

    bounded: word boundaries take letters of every script into account, as they do by default in
    the JVM; without it they are those of ASCII text, for comparison with other engines. A pattern
    is tried only on texts that hold its hint.
    """
    # one array element carries the text, so that each step names it once and plans stay small
    state = F.array(F.struct(text.alias("now"), text.alias("first"), F.lower(text).alias("low")))
    for hint, pattern, tag in _steps(bounded):
        state = F.transform(state, _tried(hint, pattern, tag))
    return state[0]["now"]


def ascii_bounds(pattern: str) -> str:
    return pattern.replace(r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def context(text: Column, pattern: str, around: int = 15) -> Column:
    """The first match with what stands up to so many characters around it, line ends made spaces."""
    return F.regexp_replace(F.regexp_extract(text, rf"(?s)(.{{0,{around}}}(?:{pattern}).{{0,{around}}})", 1), r"\r?\n", " ")


def companion_url(url: Column, mark: str = "-CD") -> Column:
    """The address of the repository beside one, mark put behind its name."""
    return F.when(url.endswith(".git"), F.concat(F.regexp_replace(url, r"\.git$", ""), F.lit(mark + ".git"))).otherwise(F.concat(F.regexp_replace(url, "/+$", ""), F.lit(mark)))
