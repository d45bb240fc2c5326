"""One query per operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagtide.session import fresh_folder

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        def prepared(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, sf)

        _FOUND[name] = (prepared, sql)
        return run

    return register


def load() -> dict[str, tuple[Callable, str | None]]:
    return dict(_FOUND)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_best_two_fit")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from tagtide.llm.packing import pack_documents

    return pack_documents(documents(spark, sf), vocabulary(), 2048, end=0)


@query("op3_rans_files")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from tagtide.llm import rans

    folder = fresh_folder(spark, "rans")
    rans.write(documents(spark, sf), folder, vocabulary(), end=2)
    return rans.read(spark, folder)


_RULES = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, x FROM win GROUP BY doc_id, x HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT win.doc_id, i, unnest(range(8)) AS k
            FROM win JOIN twice ON win.doc_id = twice.doc_id AND win.x = twice.x) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             n_symbols * 10 > n_words OR n_dup_lines * 20 > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words AS soft FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR soft) AS f FROM r GROUP BY source),
m AS (SELECT sum(f) / sum(n) AS mean, avg((f / n) * (f / n)) - avg(f / n) ** 2 AS spread, avg(1 / n) AS inverse FROM h),
s AS (SELECT mean, CASE WHEN spread - mean * (1 - mean) * inverse > 0
                        THEN least(1e6, greatest(1.0, mean * (1 - mean) / (spread - mean * (1 - mean) * inverse) - 1))
                        ELSE 1e6 END AS strength FROM m),
v AS (SELECT source, (f + mean * strength) / (n + strength) AS rate FROM h, s)
"""


@query("op10_host_rules", _RULES + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR (soft AND rate > 0.5)) AS kept
FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from tagtide.llm.hostrules import COUNTS, judged

    return judged(documents(spark, sf), own=["doc_id"]).select("_doc.doc_id", *COUNTS, "base_failed", "kept")


@query("op5_simhash_gray_index")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tagtide.llm.simhash import near_duplicates

    found = near_duplicates(documents(spark, sf))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_gated_recurrent")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from tagtide.llm.lm import scored

    return scored(documents(spark, sf))


@query("op6_neighbour_votes")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from tagtide.llm.neighbours import classified, fitted

    docs = documents(spark, sf).select("doc_id", "text")
    return classified(docs, fitted(docs, spark.read.parquet(f"{sf}/labels.parquet")))


@query("op7_word_backoff")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    from tagtide.llm.language import predicted

    return predicted(documents(spark, sf).select("doc_id", "text", "lang"))


_LINES = r"""
WITH line AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
clean AS (SELECT doc_id, line, regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS l,
                 len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS w FROM line),
unit AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS pos,
                coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t
         FROM clean WHERE w > 0),
short AS (SELECT doc_id, pos, t, w, max(t + w) OVER f AS e, max(t + w) OVER f - t AS words,
                 array_to_string(list(CAST('0x' || substr(md5(l), 1, 15) AS BIGINT)) OVER f, ',') AS body
          FROM unit WINDOW f AS (PARTITION BY doc_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING)),
named AS (SELECT *, CASE WHEN words >= 20 THEN CAST('0x' || substr(md5(body), 1, 15) AS BIGINT) END AS name FROM short),
win AS (SELECT doc_id, max(t + w) OVER f AS e, max(t + w) OVER f - t AS words,
               list(struct_pack(name := name, place := -pos, e := e)) OVER f AS c
        FROM named WINDOW f AS (PARTITION BY doc_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
chosen AS (SELECT doc_id, list_min(list_filter(c, lambda x: x.name IS NOT NULL AND x.e <= win.e)) AS s FROM win WHERE words >= 50),
full_ AS (SELECT DISTINCT doc_id, -s.place AS pos, s.name AS body FROM chosen),
first_ AS (SELECT body, min(struct_pack(d := doc_id, p := pos)) AS f FROM full_ GROUP BY body HAVING count(*) > 1),
later AS (SELECT doc_id, pos, f.d AS d0, pos - f.p AS shift FROM full_ JOIN first_ USING (body) WHERE doc_id <> f.d OR pos <> f.p),
eq AS (SELECT x.doc_id, x.d0, x.shift, u.pos, u.line,
              u.pos - row_number() OVER (PARTITION BY x.doc_id, x.d0, x.shift ORDER BY u.pos) AS g
       FROM (SELECT DISTINCT doc_id, d0, shift FROM later) x JOIN unit u ON u.doc_id = x.doc_id
       JOIN unit v ON v.doc_id = x.d0 AND v.pos = u.pos - x.shift AND v.l = u.l),
good AS (SELECT DISTINCT doc_id, d0, shift, g FROM eq JOIN later USING (doc_id, d0, shift, pos)),
span AS (SELECT doc_id, min(line) AS a, max(line) AS b FROM eq JOIN good USING (doc_id, d0, shift, g) GROUP BY doc_id, d0, shift, g),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS line FROM span),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_deleted,
                coalesce(string_agg(l.l, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS text
         FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id)
"""


@query("op8_winnowed_lines", _LINES + "SELECT doc_id, n_lines, n_deleted, md5(text) AS text_md5 FROM kept")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tagtide.llm.linedup import deduplicated

    found = deduplicated(documents(spark, sf).select("doc_id", "text"))
    return found.select("_doc.doc_id", "n_lines", "n_deleted", F.md5("text").alias("text_md5"))


@query("op9_latent_retrieval")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    from tagtide.llm.decontaminate import leaks

    return leaks(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def _licence_sql() -> str:
    from tagtide.llm.licences import KNOWN, SPELLINGS, whole_texts

    def form(text: str) -> str:
        kept = (f"array_to_string(list_filter(string_split(replace(replace(coalesce({text}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), "
                r"lambda l: NOT regexp_matches(l, '(?i)^[^a-z0-9©]*(copyright|\(c\)|©|all rights reserved)[^\n]*$') "
                r"OR regexp_matches(l, '(?i)^[^a-z0-9©]*copyright (holders?|owners?|notices?|laws?)\b')), chr(10))")
        out = rf"' ' || trim(regexp_replace(lower({kept}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
        for old, new in sorted(SPELLINGS.items(), key=lambda pair: " " not in pair[0]):
            if " " in old:
                out = f"replace({out}, ' {old} ', ' {new} ')"
        cases = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in SPELLINGS.items() if " " not in old)
        return f"trim(array_to_string(list_transform(string_split({out}, ' '), lambda w: CASE w {cases} ELSE w END), ' '))"

    known = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in [*KNOWN.items(), *whole_texts()])
    return f"""
WITH k AS (SELECT f, min(name) AS licence FROM (SELECT name, {form('body')} AS f FROM (VALUES {known}) t(name, body)) GROUP BY f),
d AS (SELECT doc_id, {form('text')} AS f FROM documents)
SELECT doc_id, CASE WHEN d.f = '' THEN 0 ELSE len(string_split(d.f, ' ')) END AS n_words,
       CASE WHEN d.f <> '' THEN sha256(d.f) END AS digest, licence
FROM d LEFT JOIN k ON d.f = k.f AND d.f <> ''"""


@query("op4_licence_digests", _licence_sql())
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from tagtide.llm.licences import known_licences, scanned

    return scanned(documents(spark, sf), known_licences(spark), ["doc_id"]).select("_doc.doc_id", "n_words", "digest", "licence")


_FIM = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
                  sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
g AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                       OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                  WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b FROM g),
p AS (SELECT *, '<P>' || substring(t, 1, a) AS prefix, '<M>' || substring(t, a + 1, b - a) AS middle, '<S>' || substring(t, b + 1, n) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN prefix || suffix || middle ELSE suffix || prefix || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


@query("op12_displacement_scatter", _FIM)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tagtide.llm.fim import restored, transformed

    made = transformed(documents(spark, sf).select("doc_id", "text")).select(
        "_doc.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), "output")
    kept = [c for c in made.columns if c != "output"]
    return restored(made, kept).select(*kept, F.sha2("restored", 256).alias("restored_sha256"))


@query("op13_block_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from tagtide.llm.whitening import whitened

    return whitened(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query("op11_induced_sorting")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tagtide.llm.substrings import deduplicated

    found = deduplicated(documents(spark, sf).select("doc_id", "text"))
    return found.select("_doc.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
