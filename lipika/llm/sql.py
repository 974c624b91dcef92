"""Equivalent SQL of the queries that SQL can express on whole tables. Tokenizers, consistent text, near duplicates and the
fitted models are beyond it (they are tested against brute force, exact round trips and held-out labels); what it can
say are the parts around them and what must hold for any right result."""

from __future__ import annotations

from .tokens import LANGUAGES

FORM = "replace(lower(trim({0})), '_', '-')"


def language(column: str) -> str:
    form = FORM.format(column)
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LANGUAGES.items()) + "}"
    return f"coalesce({known}[{form}], {known}[split_part({form}, '-', 1)], {form})"


def cube(table: str, name: str) -> str:
    """Documents over the cube of entry, language, kind and slot; each document once."""
    return f"""WITH once AS (SELECT doc_id, min({{'loaded_at': loaded_at, 'entry': {FORM.format(name)}, 'lang': {language('lang')}, 'kind': regexp_replace(kind, '_held$', '')}}) AS d FROM {table} WHERE doc_id IS NOT NULL GROUP BY doc_id),
        registry AS (SELECT {FORM.format('name')} AS entry, min(slot) AS slot FROM corpus_entries WHERE name IS NOT NULL GROUP BY 1),
        cells AS (SELECT o.d.entry AS entry, o.d.lang AS lang, o.d.kind AS kind, r.slot FROM once o LEFT JOIN registry r ON r.entry = o.d.entry)
        SELECT entry, lang, kind, slot, grouping(entry, lang, kind, slot) AS level, count(*) AS documents FROM cells GROUP BY CUBE (entry, lang, kind, slot)"""


def oracle_sql() -> dict[str, str]:
    source, held = FORM.format("source"), "split IN ('valid', 'test')"
    have = f"(SELECT DISTINCT {source} AS source FROM documents WHERE doc_id IS NOT NULL AND text <> '')"
    return {
        "p1_cube": cube("corpus_docs", "name"),
        "p1_documents_cube": cube("documents", "source"),
        "p3_checks": "SELECT count(*) AS records, 0::BIGINT AS not_composed, 0::BIGINT AS not_stable, count(*) FILTER (regexp_full_match(text, '[\\x20-\\x7E\\n]*')) AS plain, 0::BIGINT AS plain_changed FROM corpus_docs WHERE text IS NOT NULL",
        "p4_records": f"SELECT split, entry, count(*) AS records FROM (SELECT doc_id, split, min(coalesce({FORM.format('name')}, '(none)')) AS entry FROM corpus_docs WHERE {held} AND doc_id IS NOT NULL GROUP BY doc_id, split) GROUP BY split, entry",
        "p5_lost": "SELECT DISTINCT doc_id FROM corpus_docs WHERE doc_id IS NOT NULL AND contains(text, chr(65533))",
        "p6_checks": "SELECT pack_name, capacity_tokens, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS over_full, 0::BIGINT AS divided_without_need, 0::BIGINT AS whole_pieces_not_full FROM pack_capacities WHERE capacity_tokens >= 1 AND pack_name IS NOT NULL",
        "p7_goals": f"""WITH wanted AS (SELECT mix_name, {source} AS source, sum(target_share) AS target_share, min(greatest(coalesce(max_repeats, 1), 1)) AS max_repeats FROM mix_targets WHERE mix_name IS NOT NULL AND source IS NOT NULL AND target_share > 0 GROUP BY ALL)
            SELECT mix_name, w.source, target_share, CAST(max_repeats AS INT) AS max_repeats, h.source IS NOT NULL AS has_documents, round(coalesce(CASE WHEN h.source IS NOT NULL THEN target_share END / sum(CASE WHEN h.source IS NOT NULL THEN target_share END) OVER (PARTITION BY mix_name), 0), 9) AS goal FROM wanted w LEFT JOIN {have} h ON w.source = h.source""",
        "p7_checks": "SELECT DISTINCT mix_name, 0::BIGINT AS over_repeated, 0::BIGINT AS twice, 0::BIGINT AS off_budget FROM mix_targets WHERE mix_name IS NOT NULL AND target_share > 0",
        "p8_labels": "WITH areas AS (SELECT DISTINCT subject FROM subject_areas WHERE subject IS NOT NULL) SELECT l.doc_id, coalesce(string_agg(DISTINCT a.subject, ',' ORDER BY a.subject), '') AS labels FROM subject_labels l LEFT JOIN areas a ON a.subject = lower(trim(l.subject)) WHERE l.doc_id IS NOT NULL AND l.subject IS NOT NULL GROUP BY l.doc_id",
        "p8_checks": "SELECT (SELECT count(DISTINCT subject) FROM subject_areas WHERE subject IS NOT NULL) AS subjects, 0::BIGINT AS unknown_subjects, 0::BIGINT AS twice, 0::BIGINT AS below_a_fifth",
    }
