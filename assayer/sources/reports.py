"""Readers of scanners' reports: tables (report, text) of JSON documents become rows report, file, line, rule, severity, note.

A text that isn't the JSON asked for gives no rows; null texts give none either. Missing lines are 0, missing severities info.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import note, severity, tool_path

ROOT = "/work/app"


def _rows(reports: DataFrame, schema: str, path: str) -> DataFrame:
    """report and r, an element of the array at path of the parsed document."""
    parsed = reports.select("report", F.from_json("text", schema).alias("d"))
    return parsed.select("report", F.explode(path).alias("r"))


def _hits(rows: DataFrame, root: str, file: Column, line: Column, rule: Column, level: Column, text: Column) -> DataFrame:
    shown = (tool_path(file, root).alias("file"), F.coalesce(line.cast("int"), F.lit(0)).alias("line"), rule.alias("rule"), severity(level).alias("severity"), note(text).alias("note"))
    return rows.select("report", *shown)


def _said(text: Column, confidence: Column) -> Column:
    """A text with the confidence behind it, if there is one."""
    return F.concat(F.coalesce(text, F.lit("")), F.when(F.coalesce(confidence, F.lit("")) != "", F.concat(F.lit(" (confidence "), F.lower(confidence), F.lit(")"))).otherwise(""))


def _named(*parts: Column) -> Column:
    """Parts that aren't empty, with spaces between them."""
    return F.concat_ws(" ", *(F.when(p != "", p) for p in parts))


def semgrep(reports: DataFrame, root: str = ROOT) -> DataFrame:
    rows = _rows(reports, "results array<struct<path:string,start:struct<line:int>,check_id:string,extra:struct<severity:string,message:string>>>", "d.results")
    return _hits(rows, root, F.col("r.path"), F.col("r.start.line"), F.col("r.check_id"), F.col("r.extra.severity"), F.col("r.extra.message"))


def bandit(reports: DataFrame, root: str = ROOT) -> DataFrame:
    fields = "filename:string,line_number:int,test_id:string,test_name:string,issue_severity:string,issue_text:string,issue_confidence:string"
    rows = _rows(reports, f"results array<struct<{fields}>>", "d.results")
    return _hits(rows, root, F.col("r.filename"), F.col("r.line_number"), _named(F.col("r.test_id"), F.col("r.test_name")), F.col("r.issue_severity"), _said(F.col("r.issue_text"), F.col("r.issue_confidence")))


def gosec(reports: DataFrame, root: str = ROOT) -> DataFrame:
    """The first line of a range counts."""
    fields = "rule_id:string,details:string,file:string,line:string,severity:string,confidence:string,cwe:struct<id:string>"
    rows = _rows(reports, f"Issues array<struct<{fields}>>", "d.Issues")
    line = F.nullif(F.regexp_extract("r.line", r"^\s*(\d+)", 1), F.lit("")).cast("int")
    rule = _named(F.col("r.rule_id"), F.when(F.coalesce(F.col("r.cwe.id"), F.lit("")) != "", F.concat(F.lit("CWE-"), F.col("r.cwe.id"))))
    return _hits(rows, root, F.col("r.file"), line, rule, F.col("r.severity"), _said(F.col("r.details"), F.col("r.confidence")))


def sarif(reports: DataFrame, root: str = ROOT) -> DataFrame:
    """The first place of a result counts; a result without a level is a warning."""
    place = "physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>"
    runs = _rows(reports, f"runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<{place}>>>>>>", "d.runs")
    rows = runs.select("report", F.explode("r.results").alias("r")).withColumn("at", F.get("r.locations", F.lit(0))["physicalLocation"])
    return _hits(rows, root, F.col("at.artifactLocation.uri"), F.col("at.region.startLine"), F.col("r.ruleId"), F.coalesce("r.level", F.lit("warning")), F.col("r.message.text"))


def hadolint(reports: DataFrame, root: str = ROOT) -> DataFrame:
    parsed = reports.select("report", F.explode(F.from_json("text", "array<struct<file:string,line:int,code:string,level:string,message:string>>")).alias("r"))
    return _hits(parsed, root, F.col("r.file"), F.col("r.line"), F.col("r.code"), F.col("r.level"), F.col("r.message"))


def trivy(reports: DataFrame, root: str = ROOT) -> DataFrame:
    """Checks that failed, or have no status."""
    fields = "Status:string,CauseMetadata:struct<StartLine:int>,ID:string,AVDID:string,Severity:string,Title:string,Message:string"
    results = _rows(reports, f"Results array<struct<Target:string,Misconfigurations:array<struct<{fields}>>>>", "d.Results")
    rows = results.select("report", F.col("r.Target").alias("target"), F.explode("r.Misconfigurations").alias("r")).where(F.coalesce("r.Status", F.lit("")).isin("", "FAIL"))
    first = lambda *names: F.coalesce(*(F.nullif(F.col(f"r.{n}"), F.lit("")) for n in names))
    return _hits(rows, root, F.col("target"), F.col("r.CauseMetadata.StartLine"), first("ID", "AVDID"), F.col("r.Severity"), first("Title", "Message"))


def json_stream(text: str | None) -> list[str]:
    """The JSON objects that follow each other in a text; none if it breaks off or is no such stream."""
    decoder, at, out = json.JSONDecoder(), 0, []
    text = text or ""
    while (at := _next_object(text, at)) >= 0:
        try:
            _, end = decoder.raw_decode(text, at)
        except ValueError:
            return []
        out.append(text[at:end])
        at = end
    return out


def _next_object(text: str, at: int) -> int:
    return text.find("{", at)


def split_stream(reports: DataFrame) -> DataFrame:
    """report, ord, message of each object in streams of concatenated JSON."""
    # a hundred rows at a time, where an Arrow batch would hold the texts and messages of ten thousand
    messages = F.udf(json_stream, "array<string>", useArrow=False)
    return reports.select("report", F.posexplode(messages(F.coalesce("text", F.lit("")))).alias("ord", "message"))


def govulncheck(reports: DataFrame, root: str = ROOT) -> DataFrame:
    """Findings of a message stream with the advisory's summary: high if the vulnerable function is called, else low; the place is the last frame that has one."""
    frame = "module:string,version:string,package:string,function:string,position:struct<filename:string,line:int>"
    schema = f"osv struct<id:string,summary:string>, finding struct<osv:string,fixed_version:string,trace:array<struct<{frame}>>>"
    parsed = split_stream(reports).select("report", F.from_json("message", schema).alias("m"))
    said = parsed.where("m.osv.id IS NOT NULL").groupBy(F.col("report").alias("of"), F.col("m.osv.id").alias("id")).agg(F.first("m.osv.summary").alias("summary"))
    rows = parsed.where("m.finding IS NOT NULL").select("report", F.col("m.finding").alias("f"))
    rows = rows.join(said, (F.col("report") == F.col("of")) & (F.col("f.osv") == F.col("id")), "left")
    v, placed = F.get("f.trace", F.lit(0)), F.filter("f.trace", lambda t: F.coalesce(t["position"]["filename"], F.lit("")) != "")
    pos = F.when(F.size(placed) > 0, F.element_at(placed, -1)["position"])
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    where = F.concat(F.coalesce(v["module"], F.lit("?")), F.lit("@"), F.coalesce(v["version"], F.lit("?")))
    where = F.concat(where, F.when(full(v["package"]), F.concat(F.lit(" "), v["package"], F.when(full(v["function"]), F.concat(F.lit("."), v["function"])).otherwise(""))).otherwise(""))
    how = F.when(full(v["function"]), "called").when(full(v["package"]), "imported, not called").otherwise("required, not imported")
    fixed = F.when(full(F.col("f.fixed_version")), F.concat(F.lit(", fixed in "), F.col("f.fixed_version"))).otherwise("")
    text = F.concat(how, F.lit(": "), where, fixed, F.when(full(F.col("summary")), F.concat(F.lit(". "), F.col("summary"))).otherwise(""))
    file = F.coalesce(pos["filename"], F.lit("go.mod"))
    return _hits(rows, root, file, pos["line"], F.col("f.osv"), F.when(full(v["function"]), "high").otherwise("low"), text)


def advisories(reports: DataFrame) -> DataFrame:
    """Rows report, lock, name, version, ecosystem, cvss (null if unknown), ids, fixed (at most four) of dependency advisories, four levels deep."""
    events = "events:array<struct<fixed:string>>"
    vuln = f"id:string,aliases:array<string>,affected:array<struct<ranges:array<struct<{events}>>>>"
    package = f"package:struct<name:string,version:string,ecosystem:string>,groups:array<struct<ids:array<string>,max_severity:string>>,vulnerabilities:array<struct<{vuln}>>"
    results = _rows(reports, f"results array<struct<source:struct<path:string>,packages:array<struct<{package}>>>>", "d.results")
    rows = results.select("report", F.col("r.source.path").alias("lock"), F.explode("r.packages").alias("p"))
    # fields of arrays are taken without nested lambdas, which ask for their types again for each value; an empty score isn't cast, since a cast that fails throws and catches
    cvss = F.array_max(F.transform("p.groups.max_severity", lambda s: F.nullif(s, F.lit("")).try_cast("double")))
    named = lambda ids: F.coalesce(F.get(F.filter(ids, lambda i: i.startswith("CVE-")), F.lit(0)), F.get(ids, F.lit(0)))
    fixes = F.flatten(F.flatten(F.flatten("p.vulnerabilities.affected")["ranges"])["events"])["fixed"]
    fixed = F.slice(F.array_except(fixes, F.array(F.lit(None).cast("string"))), 1, 4)
    return rows.select("report", "lock", F.col("p.package.name").alias("name"), F.col("p.package.version").alias("version"), F.col("p.package.ecosystem").alias("ecosystem"), cvss.alias("cvss"), F.transform("p.groups.ids", named).alias("ids"), fixed.alias("fixed"))


def secrets(reports: DataFrame) -> DataFrame:
    """Rows report, rule, file, line, commit (seven letters), date of a secret scanner's array of hits."""
    hits = reports.select("report", F.explode(F.from_json("text", "array<struct<RuleID:string,File:string,StartLine:int,Commit:string,Date:string>>")).alias("r"))
    return hits.select("report", F.col("r.RuleID").alias("rule"), F.col("r.File").alias("file"), F.col("r.StartLine").alias("line"), F.substring("r.Commit", 1, 7).alias("commit"), F.substring("r.Date", 1, 10).alias("date"))
