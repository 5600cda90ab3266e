"""Citations, sinks, sources, workflows and the streamed event log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import citations as X
from ..functions import text as T
from ..operators import quality as Q
from ..plans.session import stage_dir
from ..sources import bibliography as B
from .records import SQL_RECORDS as R
from .records import by_key, records
from .registry import Catalog

C = Catalog()
QUERIES, SQL = C.QUERIES, C.SQL
add = C.add
_f = lambda n: f"nullif({n}, '')" if n != "year" else "CAST(nullif(year, 0) AS VARCHAR)"
_dash = "replace(nullif(pages, ''), '--', '-')"
_stop = lambda x: f"(CASE WHEN ({x}) LIKE '%.' THEN ({x}) ELSE ({x}) || '.' END)"
_INI = r"array_to_string(list_transform(list_filter(regexp_split_to_array(trim({x}), '\s+'), lambda w: w <> ''), lambda w: upper(w[1:1]) || '.'), ' ')"
_INV = (r"CASE WHEN contains(a, ',') THEN CASE WHEN trim(regexp_replace(a, '^[^,]*,', '')) <> '' THEN trim(split_part(a, ',', 1)) || ', ' || " + _INI.format(x="regexp_replace(a, '^[^,]*,', '')") + r" ELSE trim(split_part(a, ',', 1)) END"
        r" WHEN len(regexp_split_to_array(a, '\s+')) > 1 THEN regexp_split_to_array(a, '\s+')[-1] || ', ' || " + _INI.format(x=r"array_to_string(regexp_split_to_array(a, '\s+')[1:-2], ' ')") + " ELSE a END")
_XS = f"list_transform(list_transform(string_split({_f('author')}, ' and '), lambda y: trim(y)), lambda a: {_INV})"
_APA_N = f"(CASE WHEN len({_XS}) = 1 THEN {_XS}[1] ELSE array_to_string({_XS}[1:-2], ', ') || ', & ' || {_XS}[-1] END)"
_APA = ("concat_ws(' ', " + _APA_N + f", '(' || {_f('year')} || ').', CASE WHEN type = 'book' THEN '*' || {_f('title')} || '*.' ELSE {_f('title')} || '.' END, "
        f"CASE type WHEN 'article' THEN nullif(concat_ws(' ', '*' || {_f('journal')} || '*.', nullif(concat_ws(', ', {_f('volume')} || coalesce('(' || {_f('number')} || ')', ''), {_dash}), '') || '.'), '') "
        f"WHEN 'book' THEN {_f('publisher')} || '.' WHEN 'inproceedings' THEN nullif(concat_ws(' ', 'In *' || {_f('booktitle')} || '*.', '(pp. ' || {_dash} || ').'), '') "
        f"WHEN 'phdthesis' THEN '[' || concat_ws(', ', 'Doctoral dissertation', {_f('school')}) || '].' WHEN 'mastersthesis' THEN '[' || concat_ws(', ', 'Master''s thesis', {_f('school')}) || '].' END, coalesce('https://doi.org/' || {_f('doi')}, {_f('url')}))")
_FEW = lambda n: f"(CASE WHEN len(string_split({_f('author')}, ' and ')) > {n} THEN trim(string_split({_f('author')}, ' and ')[1]) || ', et al' ELSE array_to_string(list_transform(string_split({_f('author')}, ' and '), lambda y: trim(y)), ', and ') END)"
_MLA = (f"concat_ws('. ', {_FEW(2)}, CASE WHEN type = 'book' THEN '*' || {_f('title')} || '*' ELSE '\"' || {_f('title')} || '\"' END, nullif(CASE type WHEN 'article' THEN concat_ws('. ', '*' || {_f('journal')} || '*', 'vol. ' || {_f('volume')} || coalesce(', no. ' || {_f('number')}, ''), {_f('year')}, 'pp. ' || {_dash}) "
        f"WHEN 'book' THEN {_f('publisher')} || coalesce(', ' || {_f('year')}, '') WHEN 'inproceedings' THEN concat_ws('. ', '*' || {_f('booktitle')} || '*', {_f('publisher')}, {_f('year')}, 'pp. ' || {_dash}) END, ''))")
_CHI = (f"concat_ws('. ', {_FEW(3)}, CASE WHEN type = 'book' THEN '*' || {_f('title')} || '*' ELSE '\"' || {_f('title')} || '.\"' END, nullif(CASE type WHEN 'article' THEN concat_ws('. ', '*' || {_f('journal')} || '*', {_f('volume')} || coalesce(', no. ' || {_f('number')}, '') || coalesce(' (' || {_f('year')} || ')', ''), {_dash}) WHEN 'book' THEN concat_ws(', ', {_f('publisher')}, {_f('year')}) END, ''))")
_IEEE = f"concat_ws(', ', {_FEW(3)}, '\"' || {_f('title')} || '\"', {_f('journal')}, 'vol. ' || {_f('volume')}, 'no. ' || {_f('number')}, 'pp. ' || {_dash}, {_f('year')})"
for _name, _col, _sql in (("fmt01_apa", X.apa, _stop(_APA)), ("fmt03_mla", X.mla, _stop(_MLA)), ("fmt04_chicago", X.chicago, _stop(_CHI)), ("fmt07_ieee", X.ieee, _stop(_IEEE))):
    add(_name, lambda s, d, c=_col: records(s, d).select("row_id", c().alias("citation")), R + f"SELECT row_id, {_sql} AS citation FROM r")
add("fmt02_apa_names", lambda s, d: records(s, d).where("author != ''").select("row_id", X.apa_names(F.col("author")).alias("names")), R + f"SELECT row_id, {_APA_N} AS names FROM r WHERE author <> ''")
_BIB = "concat_ws(chr(10), '@' || type || '{' || key || ',', " + ", ".join(f"'  {n} = {{' || {_f(n)} || '}},'" if n != "month" else f"'  month = ' || {_f(n)} || ','" for n in X.FIELDS) + ", '}')"
add("fmt05_bibtex", lambda s, d: records(s, d).select("row_id", F.md5(X.bibtex()).alias("digest")), R + f"SELECT row_id, md5({_BIB}) AS digest FROM r")
add("fmt06_template", lambda s, d: records(s, d).select("row_id", F.concat_ws(" / ", "author", "title", F.col("year").cast("string"), "doi").alias("line")), R + "SELECT row_id, concat_ws(' / ', author, title, CAST(year AS VARCHAR), doi) AS line FROM r")
add("fmt08_cli_styles", lambda s, d: records(s, d).select("row_id", F.md5(F.concat_ws("|", X.apa(), X.mla(), X.chicago())).alias("digest")), R + f"SELECT row_id, md5(concat_ws('|', {_stop(_APA)}, {_stop(_MLA)}, {_stop(_CHI)})) AS digest FROM r")

# sinks as columns
_esc = lambda n: _nested(_f(n)) if n not in ("url", "doi", "year", "month") else _f(n)


def _nested(x):
    for a, b in T.ESCAPES:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_BIBE = "concat_ws(chr(10), '@' || type || '{' || key || ',', " + ", ".join(f"'  {n} = {{' || {_esc(n)} || '}},'" if n != "month" else f"'  month = ' || {_f(n)} || ','" for n in X.FIELDS) + ", '}')"
add("src21_encode_bibtex", lambda s, d: records(s, d).select("row_id", F.md5(X.bibtex(T.escape_tex)).alias("digest")), R + f"SELECT row_id, md5({_BIBE}) AS digest FROM r")
_KIND = "CASE type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.RIS_TYPES.items()) + " ELSE 'GEN' END"
_SPAN = f"string_split(regexp_replace({_f('pages')}, '-+', '-', 'g'), '-')"
_RIS = (f"concat_ws(chr(10), 'TY  - ' || {_KIND}, nullif(array_to_string(list_transform(string_split({_f('author')}, ' and '), lambda a: 'AU  - ' || trim(a)), chr(10)), ''), 'TI  - ' || {_f('title')}, 'JO  - ' || {_f('journal')}, 'PB  - ' || {_f('publisher')}, 'VL  - ' || {_f('volume')}, 'IS  - ' || {_f('number')}, "
        f"nullif(concat_ws(chr(10), 'SP  - ' || trim({_SPAN}[1]), CASE WHEN len({_SPAN}) > 1 THEN 'EP  - ' || trim({_SPAN}[2]) END), ''), 'PY  - ' || {_f('year')}, 'DO  - ' || {_f('doi')}, 'UR  - ' || {_f('url')}, 'ER  - ')")
add("src23_ris_sink", lambda s, d: records(s, d).select("row_id", X.ris().alias("ris")), R + f"SELECT row_id, {_RIS} AS ris FROM r")
add("src25_json_sink", lambda s, d: records(s, d).select("row_id", F.get_json_object(F.to_json(F.struct("key", "title", "year")), "$.title").alias("title")), R + "SELECT row_id, title FROM r")
add("src26_csv_sink", lambda s, d: records(s, d).select("row_id", F.concat_ws(",", "key", "type", F.array_join("keywords", "; ")).alias("line")), R + "SELECT row_id, concat_ws(',', key, type, array_to_string(keywords, '; ')) AS line FROM r")
_MD = f"concat_ws(chr(10), '### ' || {_f('title')}, '- **Authors:** ' || {_f('author')}, '- **Year:** ' || {_f('year')}, '- **Journal:** ' || {_f('journal')}, '- **DOI:** ' || {_f('doi')})"
add("src28_markdown_sink", lambda s, d: records(s, d).select("row_id", X.markdown().alias("md")), R + f"SELECT row_id, {_MD} AS md FROM r")
_cell = lambda n: f"coalesce(replace({_f(n)}, '|', '\\|'), '')"
add("src31_markdown_table", lambda s, d: records(s, d).select("row_id", X.markdown_row().alias("line")), R + f"SELECT row_id, '| ' || concat_ws(' | ', key, {_cell('type')}, {_cell('author')}, {_cell('title')}, {_cell('year')}) || ' |' AS line FROM r")
add("src32_results_export", lambda s, d: records(s, d).where(F.lower("title").contains("kriging")).select("key", "type", "title", "author", "year", "journal"), R + "SELECT key, type, title, author, year, journal FROM r WHERE contains(lower(title), 'kriging')")


# sources: records written to the shared folder in a format, and read again
def _round(s, d, write, read):
    path = f"{stage_dir(s)}/format-{uuid.uuid4().hex}"
    write(by_key(s, d), path)
    return read(path)


_SQUEEZE = r"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
add("src15_read_ris", lambda s, d: _round(s, d, lambda r, p: B.write_text(r, X.ris(), p), lambda p: B.read_ris(s, p)).groupBy("type").agg(F.count(F.lit(1)).alias("n")), R + "SELECT CASE WHEN type IN ('incollection', 'inbook') THEN 'incollection' WHEN type IN ('phdthesis', 'mastersthesis') THEN 'phdthesis' WHEN type IN ('article', 'book', 'inproceedings', 'techreport', 'online', 'dataset') THEN type ELSE 'misc' END AS type, count(*) AS n FROM k GROUP BY 1")
add("src17_ris_keys", lambda s, d: _round(s, d, lambda r, p: B.write_text(r, X.ris(), p), lambda p: B.read_ris(s, p)).select("key"))
add("src33_backup", lambda s, d: _backup(s, d), R + "SELECT count(*) AS n, 0 AS missing, 0 AS extra, 0 AS changed FROM k")
add("wf05_migrate", lambda s, d: _round(s, d, lambda r, p: r.write.parquet(p), lambda p: B.verify_copy(by_key(s, d), s.read.parquet(p))), "SELECT 0 AS missing, 0 AS extra, 0 AS changed")
add("src13_import_strategies", lambda s, d: B.resolve_keys(records(s, d).select("key", F.col("row_id").alias("ord")), "rename").select("ord", "key"), R + "SELECT row_id AS ord, key || CASE WHEN rn > 1 THEN '_' || (rn - 1) ELSE '' END AS key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_id) AS rn FROM r)")
add("wf02_export", lambda s, d: records(s, d).where("year between 2000 and 2005").join(Q.with_severity(records(s, d)).where("errors = 0").select("row_id"), "row_id", "left_semi").select("row_id", F.md5(X.bibtex()).alias("digest")))


def _backup(s, d):
    path = f"{stage_dir(s)}/backup-{uuid.uuid4().hex}"
    r = by_key(s, d)
    r.write.parquet(path)
    back = s.read.parquet(path)
    return B.verify_copy(r, back).withColumn("n", back.agg(F.count(F.lit(1))).scalar())



# the event log as a stream
def _stream(s, d, make, mode="complete"):
    from ..streaming import log as G

    name = f"log_{uuid.uuid4().hex}"
    out = make(G, _log(s, d))
    place = f"{stage_dir(s)}/{name}"
    if mode == "append":
        q = out.writeStream.outputMode("append").option("checkpointLocation", place + "-state").trigger(availableNow=True).format("parquet").start(place)
        q.awaitTermination()
        return s.read.parquet(place)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(place)

    q = out.writeStream.outputMode(mode).option("checkpointLocation", place + "-state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return s.read.parquet(place)


def _log(s, d):
    from ..streaming import log as G

    folder = f"{d}/library_events.parquet"
    base = s.readStream.schema(G.SCHEMA).parquet(folder) if _is_folder(s, folder) else s.readStream.schema(G.SCHEMA).option("pathGlobFilter", "library_events.parquet").parquet(d)
    return base.withColumn("ts", F.col("event_ts").cast("timestamp"))


def _is_folder(s, path):
    p = s._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


add("evt01_stream_counts", lambda s, d: _stream(s, d, lambda G, log: log.dropDuplicates(["event_id"]).groupBy(F.upper("event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))), "SELECT upper(event_type) AS event_type, count(DISTINCT event_id) AS n FROM library_events GROUP BY 1")


def _kept_index(s, d):
    """The upkeep of the index as a stream: each batch leaves the last change of its entries, the latest of which holds."""
    from ..streaming import log as G

    place = f"{stage_dir(s)}/index-{uuid.uuid4().hex}"
    G.keep_index(_log(s, d), place, place + "-state").awaitTermination()
    return s.read.parquet(place).groupBy("entry_key").agg(F.max(F.struct("at", "event_id", "change")).alias("v")).select("entry_key", "v.change", F.col("v.at").alias("at"))


add("evt02_stream_index", _kept_index, "SELECT lower(trim(entry_key)) AS entry_key, arg_max(upper(event_type), (event_ts, event_id)) AS change, max(event_ts) AS at FROM library_events WHERE upper(event_type) LIKE 'ENTRY_%' AND entry_key IS NOT NULL GROUP BY 1")
add("evt04_stream_progress", lambda s, d: _stream(s, d, lambda G, log: G.progress(log).select("entry_key", F.col("started").cast("timestamp_ntz").alias("started"), "n")), "SELECT lower(trim(entry_key)) AS entry_key, min(event_ts) FILTER (upper(event_type) = 'ENTRY_CREATED') AS started, count(*) AS n FROM library_events WHERE entry_key IS NOT NULL GROUP BY 1")
add("evt05_stream_windows", lambda s, d: _stream(s, d, lambda G, log: log.groupBy(F.window("ts", "30 days").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")), "SELECT time_bucket(INTERVAL 30 DAYS, event_ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM library_events GROUP BY 1")
