"""Secret scans over every historical version of every path, kept incremental
by a blob ledger.

A version's content is addressed by its SHA-256. The ledger holds, for every
blob that was scanned, the rule versions that were run on it and what they
found. An update scans only the pairs of blob and rule version that it lacks,
once per distinct blob, and adds them; what it holds for the present rules, old
findings and new ones, is joined back to all paths that ever held the blob.

All of it is DataFrame code: Java regular expressions find the matches, every
match becomes a row, and running sums over the texts between the matches give
their places in code points, so that the work is linear in the matches.

Defined results: a null content is the empty text; repeated rows share one
blob and each gets its findings; rows with a null path get theirs too; very
long texts are scanned whole; overlapping spans of different rules are all
kept, in order of start and then of the rules; an empty table gives empty
findings; columns of the input other than the path and content columns play no
part, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tombolo.llm.common import salted_left_join

#: A row of the ledger: a blob, the rule versions run on it, and what they found.
LEDGER = "blob string, rules array<string>, found array<struct<start:int,end:int,rule:string>>"
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Code points of the blocks that a text is cut into to take pieces from it.
_BLOCK = 4096
_DONE = ".done"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` are found from left to right without overlap;
    those whose ``group`` has fewer than ``least`` code points are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: The first three are the base rules; an order of their own breaks ties of start.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    # to the next END line, or over header lines and the block of base64 where there is none
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----|(?:[ \t\r\n]*[A-Za-z-]+:[^\n]*\n){0,9}[ \t\r\n\\]*[A-Za-z0-9+/=]{16,}[A-Za-z0-9+/= \t\r\n\\]*|)", version=2),
    Rule("forge_token", r"gh[oprsu]_[A-Za-z0-9]{20,}"),
    Rule("chat_token", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    # a longer scheme is matched by its end
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]{3,}@", version=2),
)
RULES = BASE_RULES + MORE_RULES


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def blobs(versions: DataFrame, content: str = "text") -> DataFrame:
    """One row (blob, text) for each distinct content."""
    text = F.coalesce(F.col(content), F.lit(""))
    return versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))


def _matches(rule: Rule) -> str:
    """SQL for the matches of a rule in ``text``, where it is to be run, with the lengths of the text before each, of the match and of its core."""
    p = _quoted(rule.pattern)
    return f"""CASE WHEN array_contains(todo, '{rule.id}') AND text RLIKE {p} THEN transform(
      filter(arrays_zip(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), regexp_extract_all(text, {p}, {rule.group})), z -> z.`1` IS NOT NULL),
      (z, i) -> named_struct('rule', '{rule.id}', 'nth', i, 'before', length(z.`0`), 'size', length(z.`1`), 'good', length(z.`2`) >= {rule.least}))
      ELSE CAST(array() AS array<struct<rule:string,nth:int,before:int,size:int,good:boolean>>) END"""


def scan(pending: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of the ledger for ``pending`` (blob, text, todo): each blob with the rules named in ``todo`` run on it."""
    every = F.expr(f"flatten(array({', '.join(map(_matches, rules))}))")
    rows = pending.select("blob", "todo", F.explode_outer(every).alias("m"))
    so_far = Window.partitionBy("blob", "m.rule").orderBy("m.nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("m.before") + F.col("m.size")).over(so_far).cast("int"))
    span = F.struct((F.col("end") - F.col("m.size")).alias("start"), "end", F.col("m.rule").alias("rule"))
    return placed.groupBy("blob").agg(F.first("todo").alias("rules"), F.collect_list(F.when(F.col("m.good"), span)).alias("found"))


class Ledger:
    """Scanned blobs in Parquet folders below ``path``, which are only ever added to; a folder counts once a mark of its name says that it is complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def rows(self) -> DataFrame:
        every, files = self._file(f"*{_DONE}")
        done = [str(s.getPath()).removesuffix(_DONE) for s in files.globStatus(every) or []]
        return self.spark.read.schema(LEDGER).parquet(*done) if done else self.spark.createDataFrame([], LEDGER)

    def unseen(self, distinct: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Adds ``todo``, the rule versions not yet run on a blob, to (blob, text); blobs with none are left out."""
        ids = F.array(*[F.lit(r.id) for r in rules])
        seen = self.rows().groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        todo = F.array_except(ids, F.coalesce("seen", F.array().cast("array<string>")))
        return distinct.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).filter(F.size("todo") > 0)

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, content: str = "text") -> None:
        """Scan what the ledger lacks of ``versions`` and add it, findings or none.

        A folder that a lost run left unfinished is never read; two runs at
        once may scan a blob twice, which changes nothing.
        """
        folder = uuid.uuid4().hex
        scan(self.unseen(blobs(versions, content), rules), rules).write.parquet(f"{self.path}/{folder}")
        where, files = self._file(folder + _DONE)
        files.create(where).close()

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, spans) of all blobs with a finding of the present versions of ``rules``, in order of start and rule."""
        rank = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.id, k)])
        kind = F.create_map(*[F.lit(x) for r in rules for x in (r.id, r.kind)])
        spans = self.rows().filter(F.size("found") > 0).select("blob", F.explode("found").alias("f")).filter(F.col("f.rule").isin(*[r.id for r in rules]))
        span = F.struct("f.start", F.try_element_at(rank, F.col("f.rule")).alias("rank"), "f.end", F.try_element_at(kind, F.col("f.rule")).alias("kind"))
        return spans.groupBy("blob").agg(F.array_sort(F.collect_set(span)).cast(_SPANS).alias("spans"))


def findings_by_path(versions: DataFrame, findings: DataFrame, path: str = "doc_id", content: str = "text") -> DataFrame:
    """(path, blob, spans) for every version, those without a finding included.

    Findings exist for few blobs; they are repeated per salt so that a blob
    that very many paths hold is not joined in one task.
    """
    paths = versions.select(path, F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("blob"))
    joined = salted_left_join(paths, findings, "blob", F.coalesce(F.col(path).cast("string"), F.lit("")))
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))


def joined_spans(spans: str, only: str = "true") -> Column:
    """``kind:start:end`` of the spans for which ``only`` (over x) holds, comma-joined in their order."""
    return F.expr(f"array_join(transform(filter({spans}, x -> {only}), x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def _kept(findings: DataFrame) -> DataFrame:
    """(blob, pieces, tail): the places (from, to) between the joined spans of a blob, and where the last one ends."""
    before = Window.partitionBy("blob").orderBy("s.start", "s.rank").rowsBetween(Window.unboundedPreceding, -1)
    spans = findings.select("blob", F.explode("spans").alias("s")).withColumn("covered", F.coalesce(F.max("s.end").over(before), F.lit(0)))
    piece = F.when(F.col("s.start") >= F.col("covered"), F.struct(F.col("covered").alias("from"), F.col("s.start").alias("to")))
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.max("s.end").alias("tail"))


def _piece(begin: str, end: str) -> str:
    """SQL for the code points from ``begin`` to ``end`` of a text that was cut into ``blocks``."""
    first, last = f"CAST({begin} div {_BLOCK} AS INT)", f"CAST({end} div {_BLOCK} AS INT)"
    of = lambda at: f"coalesce(get(blocks, {at}), '')"
    return f"""CASE WHEN {first} = {last} THEN substring({of(first)}, {begin} % {_BLOCK} + 1, {end} - {begin})
      ELSE concat(substring({of(first)}, {begin} % {_BLOCK} + 1), array_join(slice(blocks, {first} + 2, {last} - {first} - 1), ''), substring({of(last)}, 1, {end} % {_BLOCK})) END"""


def redact(versions: DataFrame, findings: DataFrame, content: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The versions with every span of ``findings`` (blob, spans) replaced by ``mark``; overlapping spans become one mark.

    Blobs with a finding, few against all, are joined to the rows. All columns
    stay, whatever their names; a null content stays null.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in versions.columns]).alias("row")
    spread = F.hash(*[F.col(f"`{c}`") for c, t in versions.dtypes if "map<" not in t])
    keyed = versions.select(row, F.sha2(F.coalesce(F.col(f"`{content}`"), F.lit("")), 256).alias("blob"), spread.alias("spread"))
    marked = salted_left_join(keyed, _kept(findings), "blob", F.col("spread"))
    text = f"row.`{content}`"
    cleaned = f"concat(array_join(transform(pieces, p -> {_piece('p.from', 'p.to')}), '{mark}'), '{mark}', {_piece('tail', f'length({text})')})"
    clean = F.expr(f"CASE WHEN pieces IS NULL THEN {text} ELSE transform(array(regexp_extract_all({text}, '[\\\\s\\\\S]{{1,{_BLOCK}}}', 0)), blocks -> {cleaned})[0] END")
    return marked.select(F.col("row").withField(f"`{content}`", clean).alias("row")).select("row.*")
