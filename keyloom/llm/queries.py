"""The registered query of each corpus operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as vocabulary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontam, langid, packing, quality, simhash, substrings, tiff, transcript, urls, warc
from keyloom.llm.common import held_out, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = tiff.with_media(docs, keep=["doc_id"])
    described = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = tiff.with_pages(described).withColumns(
        {
            "payload_bytes": F.octet_length("samples").cast("long"),
            "payload_sha256": F.sha2("samples", 256),
            "tail_crc32": F.crc32(F.expr("substring(samples, octet_length(samples) - 63, 64)")),
        }
    )
    return tiff.with_features(pages).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), max_error=0.08)


def op4_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transcripts are made of the table; their roles are recovered without its role column, which only training rows show."""
    raw = transcript.raw_transcripts(table(spark, sf_dir, "conversations"))
    rows = transcript.lines(raw, role="role")
    model = transcript.fit(rows.where(~held_out("conv")))
    turns = transcript.turns_of(rows, model)
    return turns.select(F.col("conv").alias("conv_id"), held_out("conv").alias("held_out"), "turn", "line", "role", "truth", "n_lines", F.sha2("rendered", 256).alias("rendered_sha256"), "rendered")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, vocabulary.path("byte_bpe_50k.json"), vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return substrings.without_repeats(docs, keep=["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, ~held_out())
    return quality.with_scores(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document whose number its path ends in."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    host, path = urls.parts(F.col("url"))
    made_from = F.regexp_extract(path, r"^/[a-z]+/([0-9]{1,18})", 1)
    numbered = pages.select(host.alias("host"), F.when(made_from != "", made_from.cast("long")).alias("doc_id")).where("doc_id is not null")
    outcomes = numbered.join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id")
    return urls.judge(pages, outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out())
    return langid.with_languages(docs, model, keep=["doc_id"], spans=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_tiff": op2_tiff,
        "op3_decontamination": op3_decontamination,
        "op4_transcripts": op4_transcripts,
        "op5_packing": op5_packing,
        "op6_substrings": op6_substrings,
        "op7_quality": op7_quality,
        "op8_urls": op8_urls,
        "op9_language": op9_language,
        "op10_warc": op10_warc,
    }


def _strength(name: str, groups: str, parent: str) -> str:
    p, v = "CAST(good AS DOUBLE) / n", f"{parent} * (1 - {parent})"
    return f"""{name}_sums AS (SELECT sum(n * ({p} - {parent}) * ({p} - {parent}) - {v}) AS s, sum({v} * (n - 1)) AS w FROM {groups} WHERE n > 0),
{name} AS (SELECT CASE WHEN w IS NULL OR w = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / least(greatest(s / w, 1.0::DOUBLE / 1001), 0.5::DOUBLE) - 1 END AS m FROM {name}_sums)"""


def _mean(parent: str) -> str:
    return f"(good + m * {parent}) / ((good + m * {parent}) + (n - good + m * (1 - {parent})))"


def _urls_sql() -> str:
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for h, p, _ in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    )
    verdicts = " ".join(f"WHEN '{h + p}' THEN '{v}'" for h, p, v in RULES)
    two = f"regexp_matches(last2, '{urls.TWO_LABELS}')"
    return f"""WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM rest),
split AS (SELECT page_id, translate(raw, '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM raw),
ruled AS (SELECT *, CASE {fits} END AS rule FROM split),
outcomes AS (SELECT r.host, l.quality AS good FROM ruled r JOIN labels l ON l.doc_id = TRY_CAST(nullif(regexp_extract(r.path, '^/[a-z]+/([0-9]{{1,18}})', 1), '') AS BIGINT) WHERE l.quality IN (0, 1)),
counted AS (SELECT host, CAST(sum(good) AS BIGINT) AS good, count(*) AS n FROM outcomes GROUP BY host),
named AS (SELECT host, coalesce(good, 0) AS good, coalesce(n, 0) AS n, regexp_replace(host, ':[0-9]*$', '') AS name
          FROM (SELECT DISTINCT host FROM ruled WHERE rule IS NULL) h FULL JOIN counted USING (host)),
labelled AS (SELECT *, string_split(name, '.') AS x, array_to_string(string_split(name, '.')[-2:], '.') AS last2 FROM named),
every AS (SELECT host, good, n,
    CASE WHEN regexp_matches(name, '^[0-9.]+$') OR starts_with(name, '[') THEN name WHEN {two} THEN array_to_string(x[-3:], '.') ELSE last2 END AS domain,
    CASE WHEN regexp_matches(name, '^[0-9.]+$') OR starts_with(name, '[') THEN '(address)' WHEN {two} THEN last2 ELSE x[-1] END AS suffix FROM labelled),
total AS (SELECT CASE WHEN sum(n) > 0 THEN CAST(sum(good) AS DOUBLE) / sum(n) ELSE 0.5::DOUBLE END AS overall FROM every),
by_suffix AS (SELECT suffix, sum(good) AS good, sum(n) AS n, any_value(overall) AS overall FROM every, total GROUP BY suffix),
{_strength('m1', 'by_suffix', 'overall')},
suffixes AS (SELECT suffix, {_mean('overall')} AS of_suffix FROM by_suffix, m1),
by_domain AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n, any_value(of_suffix) AS of_suffix FROM every JOIN suffixes USING (suffix) GROUP BY domain, suffix),
{_strength('m2', 'by_domain', 'of_suffix')},
domains AS (SELECT domain, suffix, {_mean('of_suffix')} AS of_domain FROM by_domain, m2),
by_host AS (SELECT host, good, n, of_domain FROM every JOIN domains USING (domain, suffix)),
{_strength('m3', 'by_host', 'of_domain')},
beta AS (SELECT host, good + m * of_domain AS a, n - good + m * (1 - of_domain) AS b FROM by_host, m3),
known AS (SELECT host, CASE WHEN a / (a + b) - 1.6448536269514722 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= 0.75 THEN 'allow' ELSE 'block' END AS verdict FROM beta)
SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE known.verdict END AS verdict FROM ruled LEFT JOIN known USING (host)"""


def oracle_sql() -> dict[str, str]:
    """op8 alone: the others hash, compress, tokenise, search or learn what SQL cannot."""
    return {"op8_urls": _urls_sql()}
