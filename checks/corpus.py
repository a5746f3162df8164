"""Script corpora derived from `part`: one SQL text that Spark and DuckDB both run.

`plain` has one bare statement per script. `annotated` wraps the same statements in
what exported scripts carry: comments with quotes in them, USE/GO/SET preambles, and
literals that look like code. `exported` holds what tools write and `nested` views with
nested select lists, both with results by hand. `linked` has views only, which read each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from checks import exported, nested

_BODY = """
case id % 7
 when 0 then 'CREATE TABLE [dbo].[part_' || id || '] (' || chr(10) || '  [id] int,' || chr(10) || '  [nm] NVARCHAR(' || (id % 50 + 1) || '),' || chr(10) || '  [doc] xml default ''{literal}' || (id % 9) || ''')'
 when 1 then 'CREATE VIEW dbo.v_' || id || ' AS' || chr(10) || 'SELECT a.id, b.nm FROM dbo.part_' || (id - 1) || ' a' || repeat(' JOIN [dbo].[v_' || (id - 7) || '] b ON a.id = b.id', id % 5)
 when 2 then 'CREATE FUNCTION dbo.f_' || id || '(@x int) RETURNS varchar(10) AS BEGIN' || case when id % 2 = 0 then ' DECLARE @y int' else '' end || ' RETURN @x END'
 when 3 then 'CREATE TRIGGER dbo.t_' || id || ' ON dbo.part_' || (id - 3) || ' AFTER INSERT AS SELECT 1'
 when 4 then 'ALTER TABLE [dbo].[part_' || (id - 4) || '] ADD CONSTRAINT fk_' || id || ' FOREIGN KEY (id) REFERENCES [dbo].[part_0](id)'
 when 5 then 'INSERT INTO dbo.part_' || (id - 5) || ' VALUES (1)'
 else 'GRANT SELECT ON dbo.part_' || (id - 6) || ' TO usr' end
"""

# Views by tens: most read the one before, a third a hub, 6 reads itself, 7 and 8 each other.
_OWN_SCHEMA = "case when id % 20 < 10 then 'dbo' else 'sales' end"
_LINKED = f"""
'CREATE VIEW ' || {_OWN_SCHEMA} || '.l_' || id || ' AS SELECT a FROM dbo.t_' || id || ' x'
|| case when id % 3 = 0 and id > 1 then ', dbo.l_1 h' else '' end
|| case when id % 10 in (0, 6) then '' else ' JOIN [' || {_OWN_SCHEMA} || '].[l_' || (id - 1) || '] y ON 1 = 1' end
|| case id % 10 when 6 then ', ' || {_OWN_SCHEMA} || '.l_' || id
  when 7 then ', ' || {_OWN_SCHEMA} || '.l_' || (id + 1) else '' end
"""

_NOTES = """
case id % 4
 when 0 then body
 when 1 then '-- owner''s note: CREATE VIEW dbo.fake' || chr(10) || body
 when 2 then '/* it''s FROM dbo.none' || chr(10) || ' JOIN */ ' || body || ' -- that''s all'
 else 'USE [shop]' || chr(10) || 'GO' || chr(10) || 'SET ANSI_NULLS ON' || chr(10) || 'GO' || chr(10) || body end
"""

LOAD_TS = "2024-05-01 00:00:00"

#: Keys that a task turns into scripts. A key is a few bytes in a file but much text work later
#: on, so that tasks cut by the bytes of the file would be few.
KEYS_PER_TASK = 20_000


def corpus_sql(variant: str, part: str = "part", with_id: bool = False) -> str:
    """Query with columns k, path, load_ts, md5, sql_body, and the script's number if asked for."""
    number = "id, " if with_id else ""
    literal = "Brand#" if variant == "plain" else "dbo.x -- xml VARCHAR(3) /*"
    noted = _NOTES if variant == "annotated" else "body"
    by_hand = {"exported": exported.body_sql, "nested": nested.body_sql}
    statements = _LINKED if variant == "linked" else _BODY.replace("{literal}", literal)
    made = by_hand[variant]() if variant in by_hand else statements
    return f"""
select k,
       'stage/' || case when k % 2 = 0 then 'a' else 'b' end || '/'
         || case when k % 13 = 0 then 'Other-' else 'MS-SQL-Server-Script-' end
         || id || '.sql' as path,
       '{LOAD_TS}' as load_ts,
       md5(sql_body) as md5,
       {number}sql_body
from (select k, id, {noted} as sql_body
      from (select k, id, {made} as body
            from (select p_partkey as k,
                         case when p_partkey % 10 = 9 then p_partkey - 1 else p_partkey end as id
                  from {part})))
"""


def corpus_tasks(spark: SparkSession, keys: int) -> int:
    """Tasks for the scripts of so many keys."""
    return max(spark.sparkContext.defaultParallelism, -(-keys // KEYS_PER_TASK))


def corpus(spark: SparkSession, sf_dir: str, variant: str = "plain") -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    part = part.repartition(corpus_tasks(spark, part.count()))
    return spark.sql(corpus_sql(variant, "{part}"), part=part)
