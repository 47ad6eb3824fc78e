"""A varied subset: records in the cells of a grid, taken round by round.  SQL only."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Part of all records that is kept.
SHARE = 0.05

# A record's cell: teacher, one of 16 question cells, length and share of digits.  Its
# signature is shared by light reworkings (the least hash of its long numbers), its lot
# decides among equals.  {numbers} is the engine's list of hashes of the long numbers.
FEATURES = """
select distinct tid, qid, teacher,
  concat_ws('|', coalesce(teacher, ''), substr(md5(qid), 1, 1),
    cast(cast(least(floor(length(text) / 250.0), 4) as int) as varchar(9)),
    cast(cast(least(floor(12.0 * (length(text) - length(translate(text, '0123456789', ''))) / length(text)), 2) as int)
      as varchar(9))) as cell,
  coalesce({numbers}, md5(text)) as signature, md5(tid) as lot
from {chains} where tid is not null and qid is not null and trim(text) <> ''
"""

# Place of a record within its cell: first the ones of each signature, of each question.
COPY = "row_number() over (partition by cell, signature order by lot, tid) as copy"
TURN = "row_number() over (partition by cell, qid order by copy, lot, tid) as turn"
PLACE = "row_number() over (partition by cell order by copy, turn, lot, tid) as place"

_SPARK_NUMBERS = "array_min(transform(regexp_extract_all(text, '[0-9]{3,}', 0), x -> md5(x)))"
_DUCKDB_NUMBERS = "list_min(list_transform(regexp_extract_all(text, '[0-9]{{3,}}'), lambda x: md5(x)))"

# The round R in which the k-th record is taken: the least R for which the cells, each
# giving at most R, hold k records.  Sorted by size, smaller cells give all they have.
_ROUND = """
with cells as (select cell, count(*) as n from {rows} group by cell),
sums as (
  select n, cell, sum(n) over (order by n, cell rows between unbounded preceding and 1 preceding) as below,
         count(*) over (order by n desc, cell desc rows between unbounded preceding and current row) as open,
         sum(n) over () as total
  from cells),
wanted as (select *, cast(ceil({share} * total) as bigint) as k from sums)
select k, cast(ceil((k - coalesce(below, 0)) / open) as bigint) as last_round
from wanted where coalesce(below, 0) + open * n >= k order by n, cell limit 1
"""

_TAKEN = """
with copies as (select *, {copy} from {{rows}}),
turns as (select *, {turn} from copies where copy <= {last}),
places as (select *, {place} from turns where turn <= {last}),
near as (select * from places where place <= {last}),
rest as (select tid, row_number() over (order by md5(cell)) as nth from near where place = {last})
select n.tid, n.qid, n.teacher, n.cell, cast(n.place as bigint) as place
from near n left join rest r on n.tid = r.tid
where n.place < {last} or r.nth <= {k} - (select count(*) from near where place < {last})
"""


def varied_subset(chains: DataFrame, share: float = SHARE) -> DataFrame:
    """``tid``, ``qid``, ``teacher``, ``cell`` and ``place`` of the kept chains.

    ``share`` of all distinct chains with text is kept, rounded up: the chains are
    ranked within their cell, reworkings of one text and further chains of one
    question after others; all first places are taken, then all second ones, and so
    on; within the last round the cells go by the hash of their name.  A null
    teacher is a cell of its own; null and blank texts, null ``tid`` and ``qid`` are
    left out; repeated rows count once; an empty table gives an empty result.
    Only the number of the last round comes to the driver; the ranks of a cell of
    any size are cut to that round before the shuffle.
    """
    spark = chains.sparkSession
    rows = spark.sql(FEATURES.replace("{numbers}", _SPARK_NUMBERS.replace("{", "{{").replace("}", "}}")), chains=chains)
    found = spark.sql(_ROUND.replace("{share}", repr(share)), rows=rows).first()
    if found is None:
        return rows.selectExpr("tid", "qid", "teacher", "cell", "cast(0 as bigint) as place").where("false")
    text = _TAKEN.format(copy=COPY, turn=TURN, place=PLACE, last=found["last_round"], k=found["k"])
    return spark.sql(text, rows=rows)


# The same by one sort of all records.
SQL = f"""
with feats as ({FEATURES.format(numbers=_DUCKDB_NUMBERS.replace("{{", "{").replace("}}", "}"), chains="candidates")}),
copies as (select *, {COPY} from feats),
turns as (select *, {TURN} from copies),
places as (select *, {PLACE} from turns),
sorted as (select *, row_number() over (order by place, md5(cell)) as nth from places)
select tid, qid, teacher, cell, place from sorted where nth <= (select ceil({SHARE!r} * count(*)) from feats)
"""
