"""URL filters: host and path rules first, else a weighted vocabulary found by Aho-Corasick.

The vocabulary is sought in the whole url, A-Z lower-cased; a term counts only between borders
(no letter or digit next to it), and once however often it stands. One strict term blocks, and so do two
soft terms or more whose weights reach ``soft_limit``. ``read_vocabulary`` takes both kinds from a file.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and
a null one is allowed; very long urls are read whole; repeated rows repeat; of the rules that fit the longest wins, and of
equally long ones the first listed; of terms within each other each counts if it has borders of its own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from strataloom.llm.common import map_texts, texts


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: str, path: str) -> bool:
        return (host == self.host or host.endswith("." + self.host)) and path.startswith(self.path)


#: The rules of the contract.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
#: Terms of which one is enough, by subject.
STRICT = tuple(
    """
    porn porno pornhub xxx xvideos sexcam sexcams camgirl camgirls hentai milf nsfw escort escorts hookup hookups
    casino casinos gambling roulette blackjack baccarat sportsbook bookmaker betting
    viagra cialis levitra xanax tramadol oxycontin steroids
    malware phishing keylogger ransomware botnet exploit-kit trojan
    warez crack keygen serialz torrentz nulled
    payday-loan payday-loans get-rich-quick ponzi
    """.split()
)
#: Terms that count by weight; several different ones together are needed.
SOFT = dict.fromkeys(
    """
    ads adserver banner banners popup popups click clicks clickbait track tracker tracking affiliate affiliates ref sponsored
    free cheap cheapest discount discounts deal deals sale sales coupon coupons promo promos bonus bonuses offer offers bargain
    win winner winners prize prizes giveaway giveaways lucky
    buy order shop cart checkout
    pill pills diet weightloss detox
    """.split(),
    1,
) | dict.fromkeys(
    """
    adult dating singles sexy nude erotic lingerie fetish
    bet bets odds jackpot lottery lotto poker slot slots bingo wager
    pharmacy pharma meds painkillers
    loan loans lender lenders cash credit-repair forex bitcoin-doubler
    spam linkfarm farm backlinks seo-tools doorway parked
    hack hacks hacked cheats
    """.split(),
    2,
)
_SPLIT = re.compile(r"://([^/?#]*)([^?#]*)")


def parts(url: str) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    found = _SPLIT.search(url)
    return (_lower(found[1]), found[2]) if found else ("", "")


def _lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


@functools.lru_cache(maxsize=8)
def _terms(strict: tuple[str, ...], soft: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in (*soft, *((t, 0) for t in strict)):  # weight 0: strict
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def read_vocabulary(lines: Iterable[str]) -> tuple[tuple[str, ...], dict[str, int]]:
    """Strict terms and soft terms with their weights, of lines ``term`` and ``term<tab>weight``; comments (#) and empty lines are skipped."""
    strict, soft = [], {}
    for line in lines:
        term, _, weight = line.split("#")[0].strip().partition("\t")
        if term and weight:
            soft[_lower(term)] = int(weight)
        elif term:
            strict.append(_lower(term))
    return tuple(strict), soft


def _inner(c: str) -> bool:
    return c.isascii() and c.isalnum()


def hits(url: str, strict: tuple[str, ...] = STRICT, soft: tuple[tuple[str, int], ...] = tuple(SOFT.items())) -> tuple[int, int, int]:
    """Numbers of different strict and soft terms between borders, and the weight of the soft ones."""
    text = _lower(url)
    seen = set()
    if not (strict or soft):
        return 0, 0, 0
    for last, (term, weight) in _terms(strict, soft).iter(text):
        first = last - len(term) + 1
        if not (first and _inner(text[first - 1]) or last + 1 < len(text) and _inner(text[last + 1])):
            seen.add((term, weight))
    weights = [w for _, w in seen if w]
    return len(seen) - len(weights), len(weights), sum(weights)


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: dict[str, int] = SOFT, soft_limit: int = 3, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight)`` for each row."""
    terms = tuple(soft.items())
    longest = sorted(rules, key=lambda r: -len(r.name))
    kind = pages.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        rows = []
        for url in texts(batch.column(1)):
            host, path = parts(url)
            rule = next((r for r in longest if r.fits(host, path)), None)
            n_strict, n_soft, weight = hits(url, strict, terms)
            method = "block" if n_strict or n_soft > 1 and weight >= soft_limit else "allow"
            rows.append((host, path, rule and rule.name, rule.verdict if rule else method, n_strict, n_soft, weight))
        columns = [*zip(*rows, strict=True)] or [()] * 7
        kinds = (pa.string(),) * 4 + (pa.int64(),) * 3
        names = ("host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight")
        return {"page_id": batch.column(0)} | {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}

    return map_texts(pages, [id_col, url_col], url_col, f"page_id {kind}, host string, path string, rule string, verdict string, n_strict bigint, n_soft bigint, soft_weight bigint", work)


def oracle() -> str:
    """DuckDB SQL of ``judge`` over the table pages with the standing rules and terms."""
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    count = lambda terms: " + ".join(f"{w} * CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t, w in terms)
    one = lambda terms: [(t, 1) for t in terms]
    longest = sorted(RULES, key=lambda r: -len(r.name))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in longest) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in longest) + " ELSE CASE WHEN n_strict > 0 OR n_soft > 1 AND soft_weight >= 3 THEN 'block' ELSE 'allow' END END"
    return f"""
WITH split AS (
  SELECT page_id, {lower("coalesce(url, '')")} AS low,
         {lower("regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
counted AS (SELECT page_id, host, path, {rule} AS rule, {count(one(STRICT))} AS n_strict, {count(one(SOFT))} AS n_soft, {count(SOFT.items())} AS soft_weight FROM split)
SELECT page_id, host, path, rule, {verdict} AS verdict, n_strict, n_soft, soft_weight FROM counted"""
