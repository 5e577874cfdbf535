"""URL filters: pattern rules found through their rarest literal token.

Every rule is a regular expression over host + path and names the tokens that each match
holds in full. The rule is filed under the token that is rarest among all given URLs; a
URL's tokens fetch the rules filed under them, and only those run.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icestats.llm.base import query
from icestats.llm.common import table

TOKEN = re.compile(r"[A-Za-z0-9]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


class Rule(NamedTuple):
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int  # the greatest wins; 0: decides only where no weighted rule fits


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the URL's path starts with `path`."""
    whole = TOKEN.findall(host + path)
    if TOKEN.fullmatch((host + path)[-1]):
        whole = whole[:-1]  # the last token may go on in a URL
    return Rule(host + path, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(whole), len(host + path))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """Fits a host with a label part `word` (labels are cut at dots and hyphens)."""
    return Rule(word, verdict, rf"(?:[^/]*[.-])?{re.escape(word)}(?:[.-][^/]*)?(?:/|$)", (word,), 0)


#: The rules of the contract, and words of hosts that are blocked where none of them fits.
RULES = (
    host_rule("allow", "com", "/"), host_rule("block", "example.com", "/en/"), host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"), host_rule("block", "net", "/fr/"),
    *(word_rule(w) for w in ("spam", "pills", "casino", "poker", "porn", "xxx", "warez", "escort")),
)


def parts(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null or a URL without `://`."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :]).groups()
    return host.translate(ASCII_LOWER), path


def token_counts(urls: DataFrame, rules: Sequence[Rule], url_col: str = "url") -> dict[str, int]:
    """In how many URLs each token of a rule stands; one small row set per token of the rules."""
    wanted = {t for r in rules for t in r.tokens}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                n.update(wanted.intersection(TOKEN.findall("".join(parts(url)))))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["token", "n"])

    rows = urls.select(url_col).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in rows.collect()}


def build_index(rules: Sequence[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """(rules by their rarest token, rules without a token)."""
    index: dict[str, list[int]] = {}
    loose = []
    for k, rule in enumerate(rules):
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(k)
        else:
            loose.append(k)
    return index, loose


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, pattern, n_tried) of every row.

    `rule` is the fitting weighted rule of greatest weight (the first listed at a tie);
    without one, `pattern` is the first fitting rule of weight 0, else `default` holds. Null
    and malformed URLs have no host, path or rule. Repeated rows are judged each.
    """
    rules = tuple(rules)
    index, loose = build_index(rules, token_counts(pages, rules, url_col))
    chosen = pages.select(F.col(id_col), F.col(url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                whole = host + path
                tried = {k for t in set(TOKEN.findall(whole)) for k in index.get(t, ())}
                tried.update(loose)
                fits = sorted((-rules[k].weight, k) for k in tried if host and compiled[k].match(whole))
                best = rules[fits[0][1]] if fits else None
                weighted = best is not None and best.weight > 0
                for col, value in zip(out, (
                    host, path, best.name if weighted else None, best.verdict if best else default,
                    best.name if best and not weighted else None, len(tried),
                )):
                    col.append(value)
            kinds = (pa.string(),) * 5 + (pa.int32(),)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))],
                [id_col, "host", "path", "rule", "verdict", "pattern", "n_tried"],
            )

    kind = chosen.schema[id_col].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, pattern string, n_tried int")


SQL = r"""
WITH cut AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule,
    regexp_extract(regexp_replace(host, '[.-]', '..', 'g'), '(^|[.])(spam|pills|casino|poker|porn|xxx|warez|escort)([.]|$)', 2) AS word
  FROM cut)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR word <> '' THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query("op5_url_rules", SQL)
def op5(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
