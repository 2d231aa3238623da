"""Credentials in text.  No output column ever carries the matched value."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewright.functions.patterns import RULES as D
from gatewright.functions.patterns import ascii_boundaries
from gatewright.functions import paths as P
from gatewright.functions import text as X
from gatewright.operators.admission import explode_lines
from gatewright.operators.findings import draft, evidence, explode_drafts
from gatewright.operators.scale import bounded_values

_EXTENSION_NEXT = ascii_boundaries(r"(?i)^\.(?:" + "|".join(D.FILE_SUFFIXES) + r")\b")
# Text that every match of a rule holds, by kind: a rule's pattern is tried only where one of its literals occurs.
LITERALS = {
    "aws_access_key": ["AKIA"],
    "github_pat": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "stripe_live_key": ["sk_live_"],
    "private_key": ["-----BEGIN "],
    "db_url": ["://"],
}
LOWER_LITERALS = {"hardcoded_password": ["password", "passwd", "pwd"]}
# A bot token has a colon for a literal, which is not rare; what stands beside it is looked for at once.
STARTS = {"telegram_bot_token": r"[0-9]:[A-Za-z0-9_-]{35}"}


def token_pattern(min_length: int = D.MIN_TOKEN_LENGTH) -> str:
    return rf"[A-Za-z0-9+/=_-]{{{min_length},}}"


# --- suppressors ---------------------------------------------------------------------
def looks_like_sample(value: Column) -> Column:
    lower = F.lower(value)
    hit = value.rlike(D.SAMPLE_PATTERN)
    for word in D.SAMPLE_SUBSTRINGS:
        hit = hit | lower.contains(word)
    return hit


def placeholder_db_url(match: Column) -> Column:
    lower = F.lower(match)
    return (
        lower.contains("localhost")
        | lower.contains("127.0.0.1")
        | match.rlike(D.PLACEHOLDER_DB_HOST)
        | match.rlike(D.PLACEHOLDER_DB_PASSWORD)
    )


def _whole(value: Column, pattern: str, rest: str) -> Column:
    """The pattern occurs and what is left around its first match looks like a name."""
    return value.rlike(pattern) & F.array_join(F.split(value, pattern, 2), "").rlike(rest)


def non_credential_shape(value: Column, line: Column) -> Column:
    """Id of the first shape that explains the token away; null when none does."""
    after = F.substring(line, F.position(value, line) + F.length(value), F.lit(16))
    names = F.split(value, "[-/]", -1)
    run = (
        (F.size(names) >= 3)
        & F.forall(names, lambda s: s.rlike(r"^[A-Za-z0-9]{2,}\z"))
        & (F.size(F.filter(names, lambda s: s.rlike(r"^[A-Za-z]{3,}\z"))) >= 2)
    )
    stem = (F.position(value, line) > 0) & after.rlike(_EXTENSION_NEXT)
    return F.coalesce(
        F.when(looks_like_sample(value), F.lit("sample-placeholder")),
        F.when(value.rlike(D.DIGEST_PATTERN), F.lit("integrity-digest")),
        F.when(value.rlike(D.IDENTIFIER_PATTERN), F.lit("separator-identifier")),
        F.when(_whole(value, D.UUID_PATTERN, D.UUID_REST), F.lit("uuid")),
        F.when(_whole(value, D.EVM_PATTERN, D.EVM_REST), F.lit("evm-address")),
        F.when(stem | run, F.lit("path-or-name-run")),
    )


# --- line scanners ---------------------------------------------------------------------
def _hit(kind: str, severity: str, reason) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(severity).alias("severity"),
        (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
    )


def _may_match(kind: str, text: Column, lower: Column) -> Column:
    """Whether a rule's literal occurs: far cheaper than its pattern."""
    where = lower if kind in LOWER_LITERALS else text
    if kind in STARTS:
        return text.contains(":") & text.rlike(STARTS[kind])
    return reduce(Column.__or__, [where.contains(word) for word in LITERALS.get(kind) or LOWER_LITERALS[kind]])


def _any_literal(text: Column) -> Column:
    return reduce(Column.__or__, [_may_match(r[0], text, F.lower(text)) for r in D.SECRET_RULES])


def _long_token(text: Column, min_length: int) -> Column:
    """A run of token characters that is long enough; looked for at the start of a run only."""
    chars = r"[A-Za-z0-9+/=_-]"
    return text.rlike(rf"(?<!{chars}){chars}{{{min_length}}}")


def _rule_hit(text: Column, lower: Column, template: Column, rule: tuple[str, str, str, str]) -> Column:
    """A hit when some match of the rule is not a sample value; null otherwise."""
    kind, severity, title, pattern = rule
    may = _may_match(kind, text, lower)
    if kind in ("private_key",):
        fires = may & text.rlike(pattern)
    else:
        sample = placeholder_db_url if kind == "db_url" else looks_like_sample
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        fires = may & text.rlike(pattern) & F.exists(found, lambda m: ~sample(m))
    if kind in D.TEMPLATE_ONLY_KINDS:
        fires = fires & ~template
    return F.when(fires, _hit(kind, severity, f"{title} pattern"))


def _pattern_hits(text: Column, path: Column) -> Column:
    """Array of the pattern hits of one line."""
    template = P.is_allowlisted_template(path)
    return F.array_compact(F.array(*[_rule_hit(text, F.lower(text), template, r) for r in D.SECRET_RULES]))


def _scan(lines: DataFrame, hits: Column) -> DataFrame:
    keys = [c for c in lines.columns if c != "text"]
    return lines.select(*keys, F.explode(hits).alias("h")).select(*keys, "h.*")


def secret_pattern_hits(lines: DataFrame) -> DataFrame:
    """One hit per (line, pattern) of a lines table."""
    return _scan(lines.where(_any_literal(F.col("text"))), _pattern_hits(F.col("text"), F.col("path")))


def entropy_tokens(text: Column, min_length: int = D.MIN_TOKEN_LENGTH) -> Column:
    """Tokens to judge, values of assignments already taken out.

    Done inside the array so that the exploded token is a plain column: the
    filters that follow mention it many times.
    """
    found = F.regexp_extract_all(text, F.lit(token_pattern(min_length)), F.lit(0))
    values = F.transform(found, lambda t: F.coalesce(X.assignment_value(t), t))
    return F.filter(values, lambda v: F.length(v) >= min_length)


def _entropy_hit(text: Column, path: Column, floor: float, min_length: int) -> Column:
    """The hit of a line that holds an unexplained token of high entropy; null otherwise.

    URLs go first; of ``NAME=value`` only the value is judged.
    """
    kind, severity, title = D.ENTROPY_KIND

    def judged(bare: Column) -> Column:
        def high(token: Column) -> Column:
            # Entropy cannot pass log2 of the alphabet: rules out most plain hex at once.
            varied = lambda counts: (F.size(counts) >= math.floor(2**floor)) & (X.entropy_of(counts) >= floor)
            return X.bind(X.char_counts(token), varied) & non_credential_shape(token, bare).isNull()

        return F.exists(entropy_tokens(bare, min_length), high)

    fires = _long_token(text, min_length) & ~P.is_allowlisted_template(path) & X.bind(X.strip_urls(text), judged)
    return F.when(fires, _hit(kind, severity, f"{title} pattern"))


def entropy_hits(
    lines: DataFrame, floor: float = D.ENTROPY_FLOOR, min_length: int = D.MIN_TOKEN_LENGTH
) -> DataFrame:
    """One hit per line holding an unexplained token of high entropy."""
    hit = _entropy_hit(F.col("text"), F.col("path"), floor, min_length)
    return _scan(lines.where(_long_token(F.col("text"), min_length)), F.array_compact(F.array(hit))).distinct()


def _known_words(wordlist: DataFrame) -> frozenset[str]:
    """The words of a list that is proven small, for the tasks' own use."""
    return frozenset(bounded_values(wordlist, "word", 2 * D.WORDLIST_SIZE))


_BETWEEN_WORDS = re.compile("[ \\t\\n\\x0b\\f\\r,]+")
_SHARE = T.StructType([T.StructField("words", T.LongType()), T.StructField("known", T.LongType())])


def _longest_run(known: frozenset[str]):
    """A column function: the largest number of words of the list in a row."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            longest = []
            for text in batch.to_pylist():
                best = now = 0
                for word in filter(None, _BETWEEN_WORDS.split(text)):
                    now = now + 1 if word in known else 0
                    best = max(best, now)
                longest.append(best)
            yield pa.array(longest, pa.int32())

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.IntegerType())


def _word_share(known: frozenset[str]):
    """A column function: how many words a text has, and how many of them are of the list."""

    def share(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = re.compile(D.WORD_TOKEN)
        for batch in texts:
            words = [token.findall(text) for text in batch.to_pylist()]
            counts = [[len(w) for w in words], [sum(x in known for x in w) for w in words]]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in counts], names=_SHARE.names)

    share.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(share, _SHARE)


def _could_be_mnemonic(text: Column) -> Column:
    return F.lower(text).rlike(rf"(?:[a-z]{{3,8}}[\s,]+){{{D.MNEMONIC_LENGTHS[0] - 1}}}[a-z]{{3,8}}")


def mnemonic_hits(lines: DataFrame, wordlist: DataFrame) -> DataFrame:
    """Lines with 12 or more consecutive words of the list, counted inside the row."""
    kind, severity, title = D.MNEMONIC_KIND
    keys = [c for c in lines.columns if c != "text"]
    longest = _longest_run(_known_words(wordlist))
    runs = lines.where(_could_be_mnemonic(F.col("text"))).select(*keys, longest(F.lower("text")).alias("run"))
    length = F.array_max(F.filter(F.lit(D.MNEMONIC_LENGTHS), lambda n: n <= F.col("run")))
    reason = F.concat(F.lit(f"{title} of "), length, F.lit(" words"))
    hits = runs.where(F.col("run") >= D.MNEMONIC_LENGTHS[0]).select(*keys, _hit(kind, severity, reason).alias("h"))
    return hits.select(*keys, "h.*")


def word_shares(files: DataFrame, wordlist: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with words and known_share of their contents."""
    share = _word_share(_known_words(wordlist))
    rows = files.where(F.col(content).isNotNull()).withColumn("_share", share(F.lower(content)))
    known = F.when(F.col("_share.words") > 0, F.col("_share.known") / F.col("_share.words"))
    return rows.withColumn("words", F.col("_share.words")).withColumn("known_share", known).drop("_share")


def wordlist_files(
    files: DataFrame, wordlist: DataFrame, min_words: int = D.WORDLIST_MIN_WORDS, share: float = D.WORDLIST_SHARE
) -> DataFrame:
    """Files that are themselves word lists: (repo_id, path, words, known_share)."""
    shares = word_shares(files.select("repo_id", "path", "content"), wordlist)
    return shares.where((F.col("words") >= min_words) & (F.col("known_share") >= share)).drop("content")


def without_word_lists(files: DataFrame, wordlist: DataFrame, content: str = "content") -> DataFrame:
    """``files`` whose contents are read and are no word list."""
    shares = word_shares(files, wordlist, content)
    is_list = (F.col("words") >= D.WORDLIST_MIN_WORDS) & (F.col("known_share") >= D.WORDLIST_SHARE)
    return shares.where(~F.coalesce(is_list, F.lit(False))).select(*files.columns)


# --- files and findings --------------------------------------------------------------------
def _may_hit(text: Column, min_length: int) -> Column:
    return _any_literal(text) | _long_token(text, min_length)


def scan_lines(
    lines: DataFrame,
    floor: float = D.ENTROPY_FLOOR,
    min_length: int = D.MIN_TOKEN_LENGTH,
) -> DataFrame:
    """Pattern and entropy hits of a lines table in one pass."""
    text, path = F.col("text"), F.col("path")
    entropy = F.array_compact(F.array(_entropy_hit(text, path, floor, min_length)))
    return _scan(lines.where(_may_hit(text, min_length)), F.concat(_pattern_hits(text, path), entropy))


def candidate_file(content: Column, min_length: int = D.MIN_TOKEN_LENGTH) -> Column:
    """Whether any rule can fire somewhere in the file; tested before splitting it."""
    return _may_hit(content, min_length)


def secret_hits(
    files: DataFrame,
    wordlist: DataFrame | None = None,
    floor: float = D.ENTROPY_FLOOR,
    min_length: int = D.MIN_TOKEN_LENGTH,
) -> DataFrame:
    """All hits of files: one scan, in which only files and then lines that can hit leave their row."""
    others = [c for c in files.columns if c != "content"]
    lines = F.transform(X.lines_of(F.col("content")), lambda line, n: F.struct((n + 1).alias("line"), line.alias("text")))
    likely = F.filter(lines, lambda x: _may_hit(x["text"], min_length))
    rows = files.where(F.col("content").isNotNull() & candidate_file(F.col("content"), min_length))
    hits = scan_lines(rows.select(*others, F.explode(likely).alias("x")).select(*others, "x.*"), floor, min_length)
    if wordlist is not None:
        hits = hits.unionByName(mnemonic_hits(explode_lines(without_word_lists(files, wordlist)), wordlist))
    return hits


def secret_findings(hits: DataFrame) -> DataFrame:
    """One finding per (repo, file, kind, line); severity lowered on soft paths."""
    keys = ["repo_id", "path", "kind", "line"]
    pos = F.min("list_pos") if "list_pos" in hits.columns else F.lit(0)
    rows = hits.groupBy(*keys).agg(
        F.min("severity").alias("severity"), F.min("reason").alias("reason"), pos.alias("pos")
    )
    titles = {r[0]: r[2] for r in [*D.SECRET_RULES, (*D.ENTROPY_KIND, ""), (*D.MNEMONIC_KIND, "")]}
    title = F.element_at(F.create_map(*[F.lit(x) for kv in titles.items() for x in kv]), F.col("kind"))
    path = F.col("path")
    fid = F.concat_ws("-", F.lit("secret"), F.col("kind"), F.col("line"), X.slugify(path))
    finding = draft(
        "security", F.col("pos"), fid, "security", P.severity_for_path(path, F.col("severity")),
        F.concat(F.lit("Possible credential: "), title),
        F.array(evidence(path, F.col("line"), F.col("reason"), "text_match")),
        "Rotate the credential, then remove it from the file.",
    )
    return explode_drafts(rows, [(F.lit(True), finding)])
