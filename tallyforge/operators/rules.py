"""Rules over lines of scripts and texts, and their findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A rule that one line breaks if it matches the pattern, and not the exception; in texts that match `given`, if there is one."""

    name: str
    pattern: str
    unless: str = ""
    given: str = ""

    def sql(self, column: str) -> str:
        """The same test on one line as SQL; a text of one line gives its own condition."""
        tests = [f"regexp_matches({column}, '{self.pattern.replace(chr(39), chr(39) * 2)}')"]
        if self.unless:
            tests.append(f"not regexp_matches({column}, '{self.unless}')")
        if self.given:
            tests.append(f"regexp_matches({column}, '{self.given}')")
        return " and ".join(tests)


RULES = [
    Rule("early-reader-pipe", r"\|\s*(head\b|grep\s+-[a-zA-Z]*q\b|grep\s+-[a-zA-Z]*m\s*\d+\b|sed\s+['\"][^'\"]*q['\"])", "141|truncate", r"\bset\s+-[a-zA-Z]*o\s+pipefail\b"),
    Rule("shared-temp-path", r"/(?:tmp|dev/shm)/[a-zA-Z0-9_-]+", "mktemp|XDG_RUNTIME_DIR"),
    Rule("ambient-shebang", r"^#!.*/usr/bin/env .*sh"),
    Rule("pipe-to-shell", r"\b(curl|wget)\b[^|]*\|\s*(sudo\s+)?(ba|z)?sh\b"),
    Rule("privilege", r"\b(sudo|pkexec|doas)\s+[-a-z/]"),
    Rule("sudoers-modification", r"/etc/sudoers|\bvisudo\b"),
    Rule("service-management", r"\b(systemctl|journalctl|loginctl)\s"),
    Rule("package-manager", r"\b(pacman|apt|apt-get|dnf|zypper|yay|paru|pip|npm)\s+(-S|install|add)\b"),
    Rule("remote-build", r"\b(cargo|go|npm|make|cmake)\s+(build|install|run|-C)\b"),
    Rule("installer", r"\binstall(er)?\.sh\b"),
    Rule("code-from-file", r"\bexec\(open\("),
]
#: Rules on names of files.
FILE_RULES = [
    Rule("agent-file", r"(?i)(^|/)(agents\.md|agent\.md|claude\.md|\.cursorrules)$"),
    Rule("bundled-binary", r"(?i)\.(so|bin|exe|dll|o|a)$"),
    Rule("script-file", r"\.(sh|py)$"),
]


def broken(text: Column, rules: list[Rule], whole: Column | None = None) -> Column:
    """The names of the rules that a line breaks; whole is the text that the line stands in. Null breaks none."""
    tests = []
    for r in rules:
        hit = text.rlike(r.pattern)
        if r.unless:
            hit = hit & ~text.rlike(r.unless)
        if r.given:
            hit = hit & (text if whole is None else whole).rlike(r.given)
        tests.append(F.when(hit, F.lit(r.name)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def findings(df: DataFrame, key: str, text: str, rules: list[Rule] = RULES) -> DataFrame:
    """key, line, rule, snippet for each line and rule it breaks. Null texts have none. No shuffle."""
    split = df.select(key, F.col(text).alias("_t"), F.posexplode(F.split(text, r"\r?\n")).alias("_p", "_l"))
    return split.select(key, (F.col("_p") + 1).alias("line"), F.explode(broken(F.col("_l"), rules, F.col("_t"))).alias("rule"), F.trim("_l").alias("snippet"))


def with_evidence(found: DataFrame, key: str, first: int = 8) -> DataFrame:
    """rule, n, evidence: distinct (key, line) places of each rule and the first few in order, as `key:line`.

    Every part of a rule's places (by hash) keeps its own first few before the parts meet, so a hot rule is spread.
    """
    places = found.groupBy("rule", key, "line").agg(F.lit(1).alias("_one")).drop("_one")
    counts = places.groupBy("rule").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64(key, "line"), F.lit(64))
    order = Window.partitionBy("rule", "_part").orderBy(key, "line")
    firsts = places.withColumn("_part", part).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= first)
    top = firsts.groupBy("rule").agg(F.slice(F.sort_array(F.collect_list(F.struct(key, "line"))), 1, first).alias("_t"))
    text = F.array_join(F.transform("_t", lambda p: F.concat_ws(":", p[key].cast("string"), p["line"].cast("string"))), " ")
    return counts.join(top, "rule").select("rule", "n", text.alias("evidence"))
