"""URL filters: pattern rules indexed by their rarest literal token, so that a URL runs only rules it may match.

A rule's pattern applies to host + path (canonical) or to the whole URL. Each rule has literal tokens (runs of a-z and
0-9, compared in lower case) of which every match contains all, as whole tokens; a pattern's are read off its parse tree. The index files a rule under the one
of them that fewest URLs hold, counted over the whole table; a URL's tokens fetch candidates, and only those run.

A null URL, or one without ://, has an empty host and path; host rules then fit nothing, and a URL that no rule matches
is allowed. Rules without a token are candidates for every URL. Of several matching rules host rules come first, the
longest winning; then patterns, blocking ones first, in their order. Rows may repeat and keys may be null. An empty
table gives an empty result; no other columns are read.

The rules are a Python list and so fit the driver; a list of over RULES_PER_PASS is split over several passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re._constants import AT, AT_BEGINNING, AT_BEGINNING_STRING, AT_END, AT_END_STRING, BRANCH, IN, LITERAL, MAX_REPEAT, NEGATE, RANGE, SUBPATTERN
from re._parser import parse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES_PER_PASS = 200_000
TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str  # allow or block
    pattern: str
    tokens: tuple[str, ...]
    host_rule: bool = False


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with `path`."""
    pattern = rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}"
    whole = path if path.endswith("/") else path.rpartition("/")[0]  # a last piece that goes on isn't a whole token
    return Rule(host + path, verdict, pattern, tuple(TOKEN.findall(f"{host}/{whole}".lower())), True)


#: The rules of the query, by host and path.
HOST_RULES = [host_rule("allow", "com", "/"), host_rule("block", "example.com", "/en/"), host_rule("allow", "www.example.com", "/en/"), host_rule("block", "net", "/es/"), host_rule("block", "net", "/fr/")]

#: What surely isn't part of a token.
OUTSIDE = frozenset(range(128)) - frozenset(map(ord, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))


def _ends(item: tuple, first: bool) -> bool:
    """Whether what this part of a pattern matches surely starts (first) or ends with other than a-z and 0-9, or lies at the URL's end."""
    op, of = item
    if op is LITERAL:
        return of in OUTSIDE
    if op is IN:
        return of[0][0] is not NEGATE and all(k is LITERAL and x in OUTSIDE or k is RANGE and OUTSIDE >= set(range(x[0], x[1] + 1)) for k, x in of)
    if op is AT:
        return of in (AT_BEGINNING, AT_BEGINNING_STRING) if not first else of in (AT_END, AT_END_STRING)  # $ also precedes a last newline, which is no part of a token
    if op is SUBPATTERN:
        return bool(of[3]) and _ends(of[3][0 if first else -1], first)
    if op is BRANCH:
        return all(bool(x) and _ends(x[0 if first else -1], first) for x in of[1])
    return op is MAX_REPEAT and of[0] > 0 and bool(of[2]) and _ends(of[2][0 if first else -1], first)


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """Whole tokens that every match of the pattern contains. What the parse tree leaves open gives none, so no match is ever lost."""
    parts: list[tuple] = []

    def flatten(items) -> None:
        for op, of in items:
            if op is SUBPATTERN and not (of[1] or of[2]):
                flatten(of[3])
            else:
                parts.append((op, of))

    tree = parse(pattern)
    if tree.state.flags & re.IGNORECASE:
        return ()  # some letters beyond ASCII would match too
    flatten(tree)
    found, run, begun, edge = [], "", False, False

    def close(bounded: bool) -> None:
        nonlocal run
        if run and begun and bounded:
            found.append(run)
        run = ""

    for i, (op, of) in enumerate(parts):
        if op is LITERAL and of < 128 and of not in OUTSIDE:
            if not run:
                begun = edge
            run, edge = run + chr(of), False
        elif op is MAX_REPEAT and of[0] == 0:
            after = next((x for x in parts[i + 1 :] if not (x[0] is MAX_REPEAT and x[1][0] == 0)), (AT, None))
            skipped = [x for x in parts[i:] if x[0] is MAX_REPEAT and x[1][0] == 0]
            close(_ends(after, True) and all(bool(x[1][2]) and _ends(x[1][2][0], True) for x in skipped))
            edge = edge and bool(of[2]) and _ends(of[2][-1], False)
        else:
            close(_ends((op, of), True))
            edge = _ends((op, of), False)
    close(False)  # what follows a match may go on
    return tuple(dict.fromkeys(found))


def pattern_rule(name: str, verdict: str, pattern: str) -> Rule:
    return Rule(name, verdict, pattern, literal_tokens(pattern))


#: Patterns over the whole URL, in lower case.
PATTERNS = [
    pattern_rule("spam-farm", "block", r"^[a-z]+://(?:[^/?#]*[.-])?spam-farm\."),
    pattern_rule("casino", "block", r"[./-]casino[./-]"),
    pattern_rule("free-pills", "block", r"[./-](?:free|cheap)-pills[./-]"),
    pattern_rule("tracker", "block", r"^[a-z]+://(?:[^/?#]*\.)?tracker\.[^/?#]+/pixel(?:[/?#]|$)"),
    pattern_rule("xxx", "block", r"^[a-z]+://(?:[^/?#]*\.)?xxx(?:\.|/|$)"),
]


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def order(rule: Rule) -> tuple[bool, int]:
    """Of several matching rules the least comes first."""
    return not rule.host_rule, -len(rule.name) if rule.host_rule else int(rule.verdict != "block")


class Index:
    def __init__(self, rules: Iterable[Rule], seen: dict[str, int]):
        self.by_token: dict[str | None, list[tuple[int, Rule, re.Pattern]]] = {}
        for i, rule in enumerate(rules):
            token = min(rule.tokens, key=lambda t: (seen.get(t, 0), -len(t), t)) if rule.tokens else None
            self.by_token.setdefault(token, []).append((i, rule, re.compile(rule.pattern)))

    def matches(self, url: str, host: str, path: str) -> list[tuple[int, Rule]]:
        lower, canonical = url.lower(), host + path
        tokens = {None, *TOKEN.findall(lower), *TOKEN.findall(canonical.lower())}
        found = [(i, r) for t in tokens for i, r, p in self.by_token.get(t, ()) if p.search(canonical if r.host_rule else lower)]
        return sorted(found, key=lambda x: (*order(x[1]), x[0]))


def token_counts(urls: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """How many URLs hold each token of the rules, over the whole table; what is broadcast and comes back is bounded by RULES_PER_PASS."""
    wanted = urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    held = urls.select(F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower(`{url}`), '[a-z0-9]+', 0)"))).alias("token"))
    return {r.token: r.n for r in held.join(F.broadcast(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge(urls: DataFrame, key: str = "page_id", url: str = "url", rules: list[Rule] | None = None) -> DataFrame:
    """key, host, path, rule (of the host rules, else null), verdict, and matched: the rule or pattern that gave it."""
    rules = [*HOST_RULES, *PATTERNS] if rules is None else rules
    blocks = [rules[i : i + RULES_PER_PASS] for i in range(0, len(rules), RULES_PER_PASS)] or [[]]
    kind = urls.schema[key].dataType.simpleString()
    best = "host string, path string, rule string, verdict string, matched string, pattern boolean, rank bigint"

    def one_pass(block: list[Rule], seen: dict[str, int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(block, seen)
            for b in batches:
                rows = []
                earlier = zip(*[c.to_pylist() for c in b.columns[2:]], strict=True) if b.num_columns > 2 else [None] * b.num_rows
                for u, before in zip(b.column(1).to_pylist(), earlier, strict=True):
                    host, path = host_and_path(u)
                    hits = index.matches(u or "", host, path)
                    first = hits[0][1] if hits else None
                    if before and before[4] is not None and (not first or before[5:] <= order(first)):
                        rows.append(before)  # of equals the earlier block's
                    else:
                        rows.append((host, path, first.name if first and first.host_rule else None, first.verdict if first else "allow", first.name if first else None, *(order(first) if first else (None, None))))
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.string()] * 5 + [pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, columns, kinds)], names=[key, "__url", "host", "path", "rule", "verdict", "matched", "pattern", "rank"])

        return run

    judged = urls.select(urls[key], urls[url].alias("__url"))
    for block in blocks:
        seen = token_counts(urls, url, sorted({t for r in block for t in r.tokens}))
        judged = judged.mapInArrow(one_pass(block, seen), f"`{key}` {kind}, __url string, {best}")
    return judged.select(key, "host", "path", "rule", "verdict", "matched")


#: The same by running every rule on every URL.
SQL = r"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, lower(coalesce(url, '')) AS url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(regexp_extract(rest, '^[^?#]*'), '/.*$', 0, 's') AS path FROM u),
r AS (SELECT *, CASE
  WHEN regexp_matches(host, '(^|\.)www\.example\.com$') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN regexp_matches(host, '(^|\.)example\.com$') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN regexp_matches(host, '(^|\.)net$') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN regexp_matches(host, '(^|\.)net$') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN regexp_matches(host, '(^|\.)com$') AND starts_with(path, '/') THEN 'com/' END AS rule,
  CASE WHEN regexp_matches(url, '^[a-z]+://([^/?#]*[.-])?spam-farm\.') THEN 'spam-farm'
  WHEN regexp_matches(url, '[./-]casino[./-]') THEN 'casino'
  WHEN regexp_matches(url, '[./-](free|cheap)-pills[./-]') THEN 'free-pills'
  WHEN regexp_matches(url, '^[a-z]+://([^/?#]*\.)?tracker\.[^/?#]+/pixel([/?#]|$)') THEN 'tracker'
  WHEN regexp_matches(url, '^[a-z]+://([^/?#]*\.)?xxx(\.|/|$)') THEN 'xxx' END AS pattern FROM h)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(rule, pattern) AS matched FROM r
"""
