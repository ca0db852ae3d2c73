"""Inputs of the audit derived from the driver's tables; the SQL runs on Spark and DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Fixture name to the query that derives it, in order of dependence.
FIXTURES: dict[str, str] = {
    "fx_numbers": """
select p_partkey as n from part where p_partkey < 64
""",
    "fx_headers": """
select p_partkey as file_id,
 concat('/lib/', p_brand, '/', lpad(cast(p_partkey as varchar(20)), 8, '0'), '.flac') as path,
 cast(case p_partkey % 8 when 0 then 44100 when 1 then 48000 when 2 then 96000 when 3 then 192000 when 4 then 88200 when 5 then 176400 when 6 then 44100 else 655351 end as int) as sample_rate,
 cast(1 + p_size % 2 as int) as channels,
 cast(case p_size % 6 when 0 then 16 when 1 then 24 when 2 then 16 when 3 then 24 when 4 then 18 else 20 end as int) as bits_per_sample,
 cast(case (p_size * 7 + p_partkey) % 8 when 0 then 4096 when 1 then 4608 when 2 then 1152 when 3 then 2304 when 4 then 8192 when 5 then 16384 when 6 then 576 else 32768 end as int) as max_blocksize,
 1 + p_partkey * 9973 as total_samples,
 cast(floor(p_retailprice * 1000) as bigint) + 8192 as file_size,
 cast(floor(p_retailprice * 1000) as bigint) as audio_size,
 1700000000000000 + p_partkey * 1000003 as mtime_us,
 case when p_partkey % 11 = 0 then repeat('0', 32) else md5(concat(p_name, cast(p_partkey as varchar(20)))) end as md5_hex,
 p_type as vendor,
 case when p_partkey % 23 = 5 then 'not_flac' end as error
from part
""",
    "fx_subframes": """
select l_partkey as file_id, l_orderkey as frame, l_linenumber as subframe,
 case when l_partkey % 12 = 5 and l_linenumber = 2 then null
      when l_partkey % 10 = 0 then case when l_linenumber = 1 then 'CONSTANT' else 'FIXED' end
      when l_partkey % 10 = 1 then case when l_linenumber = 3 then 'LPC' else 'VERBATIM' end
      else case l_linenumber when 1 then 'CONSTANT' when 2 then 'FIXED' else 'LPC' end end as type,
 cast(1 + cast(l_quantity as int) % (case when l_partkey % 5 = 2 then 14 when l_partkey % 5 = 3 then 5 else 9 end) as int) as lpc_order,
 cast(case when l_partkey % 12 = 5 and l_linenumber = 2 then 12 else l_suppkey % (case when l_partkey % 7 = 0 then 10 else 7 end) end as int) as partition_order,
 case l_partkey % 4 when 0 then 'INDEPENDENT' when 1 then 'MID_SIDE'
   when 2 then case when l_orderkey % 3 = 0 then 'LEFT_SIDE' else 'INDEPENDENT' end
   else case when l_orderkey % 3 = 0 then 'RIGHT_SIDE' else 'MID_SIDE' end end as channel_assignment
from lineitem
""",
    "fx_grid": """
select 14000 + 500 * n as hz, 'fine' as kind, cast(0 as bigint) as rung from fx_numbers where n <= 22
union all select 26000 + 2000 * n, 'coarse', cast(0 as bigint) from fx_numbers where n <= 35
union all select 42500 + 500 * n, 'edge', cast(88200 as bigint) from fx_numbers where n <= 2
union all select 46500 + 500 * n, 'edge', cast(96000 as bigint) from fx_numbers where n <= 2
""",
    "fx_bands": """
select h.file_id, h.sample_rate, g.hz, cast(case h.file_id % 9
  when 0 then -20.0 - (g.hz - 14000) / 2000.0
  when 1 then case when g.hz <= 16000 then -20.0 else -90.0 end
  when 2 then case when g.hz <= 22000 then -20.0 else -110.0 - (g.hz / 500) % 3 end
  when 3 then case when g.hz <= 24000 then -20.0 - (g.hz - 14000) / 250.0 else -60.0 + (g.hz - 24000) / 1000.0 end
  when 4 then case when g.hz <= 22000 then -20.0 - (g.hz - 14000) / 2000.0 else -65.0 + (g.hz / 500) % 2 end
  when 5 then case when g.hz <= 20500 then -20.0 else -45.0 - (g.hz - 20500) / 1000.0 end
  when 6 then -20.0 - (g.hz - 14000) / 200.0
  when 7 then case when g.hz = 30000 then -30.0 when g.hz <= 22000 then -20.0 else -65.0 end
  else case when g.hz <= 21000 then -20.0 else -115.0 end end as double) as db
from fx_headers h join fx_grid g on g.hz < h.sample_rate * 0.475
 and (g.kind = 'fine' or (h.sample_rate > 48000 and g.kind = 'coarse')
   or (g.kind = 'edge' and g.rung < h.sample_rate
       and g.rung = case when h.sample_rate % 11025 = 0 then 88200 else 96000 end))
where h.error is null and h.sample_rate <= 192000
""",
    "fx_previous": """
select file_id, path, file_size, mtime_us,
 case when file_id % 29 = 7 then 1 else 0 end as is_partial,
 case when error is null and file_id % 31 <> 8 then 1 else 0 end as has_deep, error
from fx_headers where file_id % 19 <> 6
""",
    "fx_listing": """
select file_id, path, case when file_id % 37 = 9 then file_size + 1 else file_size end as file_size,
 case when file_id % 13 = 4 then mtime_us + 5 else mtime_us end as mtime_us
from fx_headers where file_id % 17 <> 3
""",
    "fx_decode_runs": """
select file_id, path, 1 as exit_code,
 case when file_id % 3 = 0 then greatest(total_samples - 100000, 0)
      when file_id % 3 = 1 then total_samples - total_samples % max_blocksize
      else total_samples end as decoded_samples,
 case when file_id % 12 = 1 then concat('line one', chr(10), 'decoder state = 4')
      when file_id % 3 = 1 then ''
      else concat(path, ': *** Got error', chr(10), path, ': ERROR while decoding, after processing ', cast(total_samples / 2 - (total_samples / 2) % 1 as bigint), ' samples', chr(10), 'after processing 7 samples', chr(10), 'after processing 7 samples') end as stderr
from fx_headers where error is null and file_id % 6 in (0, 1, 2)
""",
    "fx_originals": """
select file_id, concat(substring(path, 1, length(path) - 5), case when file_id % 2 = 0 then '.orig.flac' else '.ORIG.FLAC' end) as path,
 file_size * 2 as file_size
from fx_headers where file_id % 5 = 0
""",
    "fx_new_headers": """
select path, case when file_id % 41 = 1 then 48000 else sample_rate end as sample_rate, channels,
 case when file_id % 43 = 2 then 16 else bits_per_sample end as bits_per_sample,
 case when file_id % 7 = 3 then total_samples - 3 else total_samples end as total_samples,
 case when file_id % 16 = 4 then repeat('0', 32) when file_id % 9 = 5 then md5(path) else md5_hex end as md5_hex
from fx_headers where error is null and file_id % 2 = 0
""",
    "fx_outcomes": """
select o.o_orderkey as res_id, h.file_id,
 case o.o_orderpriority when '1-URGENT' then 'reencode' when '2-HIGH' then 'convert' when '3-MEDIUM' then 'subset' when '4-NOT SPECIFIED' then 'header' else 'salvage' end as kind,
 case o.o_orderstatus when 'F' then 'done' when 'O' then 'dry_run' else 'failed' end as status,
 h.file_size as old_size, h.file_size - cast(floor(o.o_totalprice) as bigint) + 150000 as new_size,
 h.total_samples - o.o_custkey % 500 as recovered_samples
from orders o join fx_headers h on h.file_id = o.o_orderkey % 200
""",
    "fx_vectors": """
select label as file_id, row_number() over (partition by label order by vec_id) - 1 as window_idx,
 case when label % 2 = 0 then 44100 else 96000 end as sample_rate,
 case when label % 5 = 0 then 24 else 16 end as bits_per_sample, embedding as samples
from embeddings
""",
    "fx_probe_streams": """
select l_orderkey as file_id, l_linenumber as stream_idx,
 case when l_linenumber = 1 then 'video' when l_linenumber <= 4 then 'audio' else 'subtitle' end as codec_type,
 min(cast(l_suppkey * 16 as int)) as width, min(cast(l_suppkey * 9 as int)) as height
from lineitem group by l_orderkey, l_linenumber
""",
    "fx_page_images": """
select conv_id as doc, concat('doc', cast(conv_id as varchar(20)), '_scan-', lpad(cast(turn as varchar(20)), 3, '0'), '.jpg') as file_name
from conversations
""",
    "fx_frames": """
select distinct file_id, frame, channel_assignment from fx_subframes
""",
}
#: Tables that the fixtures read.
TABLES = ("part", "lineitem", "orders", "embeddings", "conversations")


def _needed(names: tuple[str, ...] | list[str]) -> list[str]:
    """The fixtures named and those they read, in order."""
    wanted: set[str] = set()
    queue = list(names)
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue += [n for n in re.findall(r"\bfx_\w+", FIXTURES[name]) if n in FIXTURES and n != name]
    return [n for n in FIXTURES if n in wanted]


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture over the tables in sf_dir."""
    needed = _needed([name])
    for table in TABLES:
        if any(re.search(rf"\b{table}\b", FIXTURES[n]) for n in needed):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    for n in needed:
        spark.sql(FIXTURES[n]).createOrReplaceTempView(n)
    return spark.table(name)


def with_fixtures(query: str) -> str:
    """query, a SELECT or further CTEs and a SELECT, after the fixtures that it names."""
    named = [n for n in dict.fromkeys(re.findall(r"\bfx_\w+", query)) if n in FIXTURES]
    ctes = ", ".join(f"{n} AS ({FIXTURES[n].strip()})" for n in _needed(named))
    body = query.strip()
    if body.lower().startswith("with "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
