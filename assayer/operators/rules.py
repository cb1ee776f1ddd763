"""The rule registry: what makes a place in a text worth a look, as data, and its compilation to columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import java, re2


@dataclass(frozen=True)
class Rule:
    """A pattern that Java and RE2 read alike; unless is a second pattern that must not match.

    hints are literals in lower case, of which a text that the pattern matches holds one in some case; others aren't searched.
    """

    name: str
    points: int
    pattern: str
    reason: str
    unless: str = ""
    hints: tuple[str, ...] = ()

    def column(self, text: Column, lower: Column) -> Column:
        hit = text.rlike(java(self.pattern))
        if self.hints:
            hit = reduce(Column.__or__, (lower.contains(h) for h in self.hints)) & hit
        return hit & ~text.rlike(self.unless) if self.unless else hit

    def sql(self, text: str) -> str:
        hit = f"regexp_matches({text}, '{re2(self.pattern)}')"
        return f"({hit} AND NOT regexp_matches({text}, '{re2(self.unless)}'))" if self.unless else hit


#: What stands before and behind a word; a letter of a word follows the first.
START, END = r"\b\b", r"\b"
# Points of areas and of what is found.
AREAS = [
    Rule("auth", 3, rf"(?i){START}(login|sign-?in|password|session|token)", "auth", hints=("login", "sign", "password", "session", "token")),
    Rule("admin", 3, rf"(?i){START}admin", "admin", hints=("admin",)),
    Rule("payments", 2, rf"(?i){START}(payment|invoice|card|iban)", "payments", hints=("payment", "invoice", "card", "iban")),
    Rule("files", 2, rf"(?i){START}(upload|attachment|file)", "files", hints=("upload", "attachment", "file")),
    Rule("jobs", 1, rf"(?i){START}(queue|cron|worker)", "jobs", hints=("queue", "cron", "worker")),
]
AREA_CAP = 5
SINKS = [
    Rule("mail", 2, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", "holds an e-mail address", hints=("@",)),
    Rule("address", 2, rf"{START}[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}{END}", "holds a network address", hints=(".",)),
    Rule("hex-token", 3, rf"{START}[0-9a-f]{{40}}{END}", "holds a long hexadecimal token"),
    Rule("digits", 1, rf"{START}[0-9]{{3}}[- ][0-9]{{2,3}}[- ][0-9]{{4}}{END}", "holds a number with groups"),
    Rule("licence", 1, rf"(?i){START}licen[sc]e{END}", "mentions a licence", hints=("licen",)),
    Rule("script", 2, r"(?i)<script[^>]*>", "holds a script", hints=("<script",)),
    Rule("sql-text", 3, rf"(?i){START}select[^A-Za-z0-9_;](?:[^;]{{0,198}}[^A-Za-z0-9_;])?from[^A-Za-z0-9_;][^;]{{0,199}}(\+|\$\{{|%s|\|\|)", "SQL made of strings", hints=("select",)),
    Rule("process", 3, rf"{START}(child_process|subprocess|os\.system|shell_exec|proc_open|exec\.Command){END}", "starts a process", hints=("child_process", "subprocess", "os.system", "shell_exec", "proc_open", "exec.command")),
    Rule("raw-html", 2, rf"{START}(innerHTML|dangerouslySetInnerHTML|mark_safe){END}", "writes raw HTML", hints=("innerhtml", "dangerously", "mark_safe")),
    Rule("redirect", 2, rf"(?i){START}redirect\((req|request|ctx|params|query)", "redirects where the request says", hints=("redirect(",)),
    Rule("loads", 3, rf"{START}(pickle\.loads?|unserialize|yaml\.load)\(", "reads objects from untrusted bytes", r"SafeLoader", hints=("pickle", "unserialize", "yaml.load")),
    Rule("tenant", 3, rf"(?i){START}(body|query|input)\.(tenant|owner|org)_?id{END}", "takes the owner from the request", hints=(".tenant", ".owner", ".org", ".id")),
    Rule("owned-fetch", 3, rf"{START}(fetch|requests\.get|http\.Get)\([A-Za-z_]", "calls a computed address", r"allowlist|allow_list", hints=("fetch(", "get(")),
    Rule("shout", 1, r"[A-Z]{4,}!!", "shouts", hints=("!!",)),
    Rule("symbols", 1, r"[#$%&*]{3}", "runs of symbols"),
]


def hits(rules: list[Rule], text: Column, lower: Column) -> Column:
    """Whether each rule holds of a text, and lower, the same in lower case, as an array; explode it as one row so that no rule is tried again for each use of it."""
    return F.array(*(rule.column(text, lower) for rule in rules))


def points(rules: list[Rule], hits: Column, first: int = 0) -> Column:
    """The points of the rules, which stand in hits from first on."""
    total = F.lit(0)
    for n, rule in enumerate(rules, first):
        total = total + F.when(hits[n], rule.points).otherwise(0)
    return total


def reasons(rules: list[Rule], hits: Column) -> Column:
    return F.concat_ws("; ", *(F.when(hits[n], F.lit(rule.reason)) for n, rule in enumerate(rules)))


def points_sql(rules: list[Rule], text: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {r.sql(text)} THEN {r.points} ELSE 0 END" for r in rules) + ")"


def reasons_sql(rules: list[Rule], text: str) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {r.sql(text)} THEN '{r.reason}' END" for r in rules) + ")"
