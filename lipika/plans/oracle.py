"""Equivalent SQL of the core queries, for DuckDB on the same tables. Written from the definitions, not from the plans."""

from __future__ import annotations

from ..functions.scripts import DEFAULT_SLOT_MAP, SCRIPT_RANGES, STRUCT

SPACE = r"[\p{Z}\t\n\x0b\f\r]"
# Fixed value: white space on which words are split.
WORD_SPLIT = r"[\p{Z}\t\n\x0b\f\r\x1c-\x1f\x{85}]+"


def _case(column: str, mapping: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{default}' END"


def raw_script(ch: str = "ch") -> str:
    """Script of one character; NULL where it is inherited."""
    blocks = " ".join(f"WHEN unicode({ch}) BETWEEN {a} AND {b} THEN '{s}'" for s, ranges in SCRIPT_RANGES.items() for a, b in ranges)
    return f"""CASE WHEN regexp_matches({ch}, '{SPACE}') OR regexp_matches({ch}, '[\\p{{N}}\\p{{P}}\\p{{S}}]') THEN 'COMMON' {blocks}
        WHEN regexp_matches({ch}, '[\\p{{M}}]') OR unicode({ch}) IN (8204, 8205) OR unicode({ch}) BETWEEN 65024 AND 65039 THEN NULL ELSE 'UNKNOWN' END"""


def chars(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTE chars(doc_id, pos, ch, st, raw, ws): every character, whether it is structural, its own script, white space."""
    return f"""given AS (SELECT {key} AS doc_id, nfc_normalize({text}) AS text FROM {table} WHERE {text} IS NOT NULL AND {text} <> ''),
    lists AS (SELECT doc_id, string_split_regex(text, '{STRUCT}') AS parts, regexp_extract_all(text, '{STRUCT}') AS spans FROM given),
    pieces AS (SELECT doc_id, 2 * i AS ord, false AS st, parts[i] AS s FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM lists)
        UNION ALL SELECT doc_id, 2 * i + 1, true, spans[i] FROM (SELECT doc_id, spans, unnest(range(1, len(spans) + 1)) AS i FROM lists)),
    split AS (SELECT doc_id, ord, st, unnest(string_split(s, '')) AS ch, generate_subscripts(string_split(s, ''), 1) AS k FROM pieces WHERE s <> ''),
    chars AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, k) - 1 AS pos, ch, st, {raw_script()} AS raw, regexp_matches(ch, '{SPACE}') AS ws FROM split)"""


def runs(mode: str = "leading", table: str = "documents", slots: dict[str, str] | None = None) -> str:
    """CTE runs(doc_id, run_pos, slot, text, start, end, script)."""
    slot = _case("script", {"CODE_MATH": "CODE_MATH", "INITIAL": "NEUTRAL"} | (DEFAULT_SLOT_MAP if slots is None else slots), "CATCHALL")
    attached = (
        "coalesce(first_value(CASE WHEN ws AND NOT st THEN NULL ELSE own END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(CASE WHEN ws AND NOT st THEN NULL ELSE own END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'INITIAL')"
        if mode == "leading"
        else "own"
    )
    return f"""{chars(table)},
    own AS (SELECT *, CASE WHEN st THEN 'CODE_MATH' ELSE coalesce(raw, last_value(CASE WHEN st THEN NULL ELSE raw END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'INITIAL') END AS own FROM chars),
    settled AS (SELECT doc_id, pos, ch, {attached} AS script FROM own),
    slotted AS (SELECT *, {slot} AS slot FROM settled),
    flagged AS (SELECT *, CASE WHEN slot IS DISTINCT FROM lag(slot) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS edge FROM slotted),
    numbered AS (SELECT *, sum(edge) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS run_pos FROM flagged),
    runs AS (SELECT doc_id, CAST(run_pos AS INT) AS run_pos, any_value(slot) AS slot, string_agg(ch, '' ORDER BY pos) AS text, CAST(min(pos) AS INT) AS start, CAST(max(pos) + 1 AS INT) AS "end", replace(arg_min(script, pos), 'INITIAL', 'COMMON') AS script FROM numbered GROUP BY doc_id, run_pos)"""


GROUPED = {"COMMON": "NEUTRAL", "LATIN": "EUROPEAN", "GREEK": "EUROPEAN", "CYRILLIC": "EUROPEAN", "DEVANAGARI": "INDIC", "KANNADA": "INDIC"}
BYTES = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(concat('0x', x) AS INTEGER))"
WORDS = f"list_filter(string_split_regex(text, '{WORD_SPLIT}'), lambda w: w <> '')"
TEXTS = "(SELECT * FROM documents WHERE text IS NOT NULL)"
FILLED = "(SELECT * FROM documents WHERE text IS NOT NULL AND text <> '')"
DOMINANT = """per AS (SELECT doc_id, slot, sum(length(text)) AS n, min(run_pos) AS first FROM runs WHERE slot <> 'NEUTRAL' GROUP BY ALL),
    best AS (SELECT doc_id, slot, n, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM per),
    dominant AS (SELECT d.doc_id, coalesce(b.slot, 'NEUTRAL') AS slot, CAST(coalesce(100 * b.n // b.total, 0) AS BIGINT) AS purity FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id AND b.rank = 1 WHERE d.text IS NOT NULL)"""


def _letters() -> str:
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return "[" + ", ".join(f"chr({b if b in own else next(free)})" for b in range(256)) + "]"


def oracle_sql() -> dict[str, str]:
    from .evaluation_sql import evaluation_sql

    leading, neutral = runs(), runs("neutral")
    sentence = "SELECT unnest(string_split(text, '।')) AS sentence FROM corpus_docs WHERE text IS NOT NULL AND split = "
    slot_of_id = "i.id >= r.start_id AND i.id < r.end_id"
    byte_ids = f"(SELECT doc_id, lang, list_transform({BYTES}, lambda b: b + start_id) AS ids FROM {FILLED} CROSS JOIN (SELECT start_id FROM slot_ranges WHERE name = 'CATCHALL'))"
    return evaluation_sql() | {
        "scan_documents": "SELECT doc_id, kind, CAST(length(text) AS BIGINT) AS chars FROM documents",
        "read_slot_partition": f"WITH {leading} SELECT count(*) AS runs, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM runs WHERE slot = 'KANNADA'",
        "extract_text_filtered": f"SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS chars FROM (SELECT doc_id, substring(t, 1, 1000) AS t FROM (SELECT doc_id, regexp_replace(text, '^{WORD_SPLIT}|{WORD_SPLIT}$', '', 'g') AS t FROM {TEXTS}) WHERE length(t) >= 200)",
        "loose_jsonl_text": f"""SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS chars FROM (SELECT doc_id, nullif(CASE WHEN doc_id % 7 = 5 THEN regexp_replace(text, '^{WORD_SPLIT}|{WORD_SPLIT}$', '', 'g') WHEN doc_id % 7 = 6 THEN '{{broken}}' WHEN doc_id % 4 = 3 THEN NULL ELSE text END, '') AS t FROM {TEXTS}) WHERE t IS NOT NULL""",
        "group_first_seen": "SELECT source, min(doc_id) AS first_id, count(*) AS documents FROM documents GROUP BY source",
        "concat_string_fields": "SELECT doc_id, j AS joined FROM (SELECT doc_id, concat_ws(' ', trim(kind, ' '), trim(lang, ' '), trim(source, ' ')) AS j FROM documents) WHERE length(j) >= 20",
        "sample_by_char_budget": f"SELECT lang, count(*) AS documents, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT lang, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {TEXTS}) WHERE before < 20000 GROUP BY lang",
        "char_cap_take": f"SELECT doc_id, n AS chars FROM (SELECT doc_id, CAST(length(text) AS BIGINT) AS n, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {TEXTS}) WHERE before < 200000",
        "limit_docs": "SELECT doc_id, kind FROM documents ORDER BY doc_id LIMIT 50",
        "heldout_word_shuffle": f"""WITH w AS (SELECT doc_id, kind, {WORDS} AS w FROM {TEXTS} WHERE kind IS NULL OR kind NOT IN ('code', 'math', 'markdown')),
            each AS (SELECT doc_id, kind, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS k FROM w WHERE len(w) >= 3)
            SELECT concat('held-', doc_id) AS doc_id, concat(coalesce(any_value(kind), ''), '_held') AS kind, md5(string_agg(word, ' ' ORDER BY md5(concat('9999:', doc_id, ':', k)), k)) AS digest FROM each GROUP BY doc_id""",
        "positional_split": "SELECT lang, CASE WHEN place <= greatest(1, floor(n * (1 - 0.15::DOUBLE))) THEN 'train' ELSE 'held' END AS part, count(*) AS documents, min(doc_id) AS first_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents) GROUP BY 1, 2",
        "seeded_shuffle": "SELECT doc_id, kind, row_number() OVER (PARTITION BY kind ORDER BY md5(concat('1337:', doc_id)), doc_id) AS place FROM documents",
        "sentence_overlap": f"WITH h AS ({sentence}'test'), t AS (SELECT DISTINCT sentence FROM ({sentence}'train')) SELECT count(*) AS sentences, count(t.sentence) AS hits, coalesce(count(t.sentence) / nullif(count(*), 0)::DOUBLE, 0) AS overlap FROM h LEFT JOIN t USING (sentence)",
        "slot_corpus_bytes": f"WITH {leading} SELECT slot, count(*) AS runs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM runs GROUP BY slot",
        "segment_leading": f"WITH {leading} SELECT * FROM runs",
        "segment_neutral": f"WITH {neutral} SELECT * FROM runs",
        "segment_grouped": f"WITH {runs(slots=GROUPED)} SELECT doc_id, run_pos, slot, start, \"end\" FROM runs",
        "runs_exploded": f"WITH {leading} SELECT doc_id, count(*) AS runs, max(\"end\") AS chars FROM runs GROUP BY doc_id",
        "runs_by_slot": f"WITH {leading} SELECT doc_id, run_pos, text FROM runs WHERE slot = 'DEVANAGARI'",
        "structural_spans": f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS pos, unnest(s) AS span FROM (SELECT doc_id, regexp_extract_all(nfc_normalize(text), '{STRUCT}') AS s FROM {TEXTS})",
        "char_script_histogram": f"SELECT script, count(*) AS chars FROM (SELECT coalesce({raw_script()}, 'INHERITED') AS script FROM (SELECT unnest(string_split(nfc_normalize(text), '')) AS ch FROM {FILLED})) GROUP BY script",
        "char_slot_histogram": f"SELECT {_case('script', DEFAULT_SLOT_MAP | {'INHERITED': 'INHERITED'}, 'CATCHALL')} AS slot, count(*) AS chars FROM (SELECT coalesce({raw_script()}, 'INHERITED') AS script FROM (SELECT unnest(string_split(nfc_normalize(text), '')) AS ch FROM {FILLED})) GROUP BY 1",
        "nfc_normalize": "SELECT DISTINCT doc_id, md5(nfc_normalize(text)) AS digest FROM corpus_docs WHERE text IS NOT NULL",
        "dominant_slot": f"WITH {leading}, {DOMINANT} SELECT * FROM dominant",
        "pure_documents": f"WITH {leading}, {DOMINANT} SELECT slot, count(*) AS documents FROM dominant WHERE slot <> 'NEUTRAL' AND purity >= 90 GROUP BY slot",
        "balance_by_script": f"""WITH {leading}, {DOMINANT}, pure AS (SELECT doc_id, slot, strlen(d.text) AS bytes FROM dominant JOIN documents d USING (doc_id) WHERE slot <> 'NEUTRAL' AND purity >= 90),
            target AS (SELECT min(b) AS target FROM (SELECT sum(bytes) AS b FROM pure GROUP BY slot)),
            cut AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY slot ORDER BY md5(concat('1337:', doc_id)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pure)
            SELECT doc_id, slot, bytes FROM cut, target WHERE before < target""",
        "whitespace_mode_cost": f"SELECT slot, coalesce(leading_runs, 0) AS leading_runs, coalesce(leading_chars, 0) AS leading_chars, coalesce(neutral_runs, 0) AS neutral_runs, coalesce(neutral_chars, 0) AS neutral_chars FROM (WITH {leading} SELECT slot, count(*) AS leading_runs, CAST(sum(length(text)) AS BIGINT) AS leading_chars FROM runs GROUP BY slot) FULL JOIN (WITH {neutral} SELECT slot, count(*) AS neutral_runs, CAST(sum(length(text)) AS BIGINT) AS neutral_chars FROM runs GROUP BY slot) USING (slot)",
        "slot_markers": f"WITH {leading} SELECT doc_id, count(*) - 1 AS markers, string_agg(slot, '|' ORDER BY run_pos) AS slots FROM runs GROUP BY doc_id",
        "lexical_diversity": f"WITH {leading} SELECT slot, count(*) AS runs, count(DISTINCT text) AS distinct_runs, CAST(sum(length(text)) AS BIGINT) AS chars FROM runs GROUP BY slot",
        "doc_text_stats": f"SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes, CAST(len({WORDS}) AS BIGINT) AS words FROM {TEXTS}",
        "byte_encode": f"SELECT doc_id, md5(array_to_string({BYTES}, ' ')) AS ids, CAST(strlen(text) AS BIGINT) AS tokens FROM {TEXTS}",
        "byte_roundtrip": f"SELECT decode(encode(text)) = text AS exact, count(*) AS documents FROM {TEXTS} GROUP BY 1",
        "byte_level_text": f"SELECT doc_id, md5(array_to_string(list_transform({BYTES}, lambda b: letters[b + 1]), '')) AS digest FROM {TEXTS}, (SELECT {_letters()} AS letters)",
        "doc_sha256": f"SELECT doc_id, sha256(text) AS sha256 FROM {TEXTS}",
        "lang_benchmark": f"SELECT *, CASE WHEN words > 0 THEN bytes::DOUBLE / words END AS bytes_per_word, CASE WHEN chars > 0 THEN bytes::DOUBLE / chars END AS bytes_per_char FROM (SELECT lang, count(*) AS documents, CAST(sum(len({WORDS})) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM {TEXTS} GROUP BY lang)",
        "observed_alphabet": f"SELECT byte, count(*) AS documents FROM (SELECT unnest(list_distinct({BYTES})) AS byte FROM {TEXTS}) GROUP BY byte",
        "padded_vocab": "SELECT CAST(max(end_id) AS BIGINT) AS vocab_size, CAST(ceil(max(end_id) / 128.0) * 128 AS BIGINT) AS padded_vocab_size FROM slot_ranges",
        "embedding_params": "SELECT name, (end_id - start_id)::BIGINT * 2048 AS tied, (end_id - start_id)::BIGINT * 4096 AS untied FROM slot_ranges",
        "id_layout": "SELECT name, CAST(5 + coalesce(sum(size) OVER (ORDER BY start_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_id, CAST(5 + sum(size) OVER (ORDER BY start_id) AS INT) AS end_id, algorithm, size FROM slot_ranges",
        "layout_violations": "SELECT name, 'not contiguous' AS violation FROM (SELECT name, start_id, coalesce(lag(end_id) OVER (ORDER BY start_id, name), 5) AS before FROM slot_ranges) WHERE start_id <> before UNION ALL SELECT name, 'empty' FROM slot_ranges WHERE end_id <= start_id UNION ALL SELECT name, 'size differs' FROM slot_ranges WHERE end_id - start_id <> size",
        "id_to_slot": f"SELECT CAST(i.id AS INT) AS id, r.name AS slot, CAST(i.id - r.start_id AS INT) AS local_id FROM (SELECT range AS id FROM range(-2, (SELECT max(end_id) FROM slot_ranges) + 40)) i LEFT JOIN slot_ranges r ON {slot_of_id}",
        "id_space_sound": f"SELECT count(*) AS ids, CAST(sum(CASE WHEN r.name IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unrouted FROM (SELECT range AS id FROM range(5, (SELECT max(end_id) FROM slot_ranges))) i LEFT JOIN slot_ranges r ON {slot_of_id}",
        "describe_layout": "SELECT r.name, r.start_id, r.end_id, r.algorithm, array_to_string(s.scripts, ',') AS scripts, s.structural, s.trained FROM slot_ranges r JOIN slot_specs s USING (name)",
        "vocab_freeze": "SELECT slot AS name, CAST(5 + sum(n) OVER (ORDER BY o) - n AS INT) AS start_id, CAST(5 + sum(n) OVER (ORDER BY o) AS INT) AS end_id, 'frozen' AS algorithm, CAST(n AS INT) AS size FROM (SELECT slot, count(*) AS n, min(id) AS o FROM slot_vocab WHERE slot IS NOT NULL GROUP BY slot)",
        "local_vocab": "SELECT id, slot, CAST(row_number() OVER (PARTITION BY slot ORDER BY id) - 1 AS INT) AS local_id FROM slot_vocab WHERE slot IS NOT NULL",
        "local_to_global": "SELECT v.id, v.slot, CAST(r.start_id + v.local_id AS INT) AS global_id FROM slot_vocab v JOIN slot_ranges r ON v.slot = r.name",
        "token_to_first_id": "SELECT token, min(id) AS first_id, count(*) AS ids FROM slot_vocab GROUP BY token",
        "byte_tax": "SELECT slot, count(*) AS rows, CAST(sum(CASE WHEN strlen(token) = 1 OR regexp_matches(token, '^<0x[0-9A-F]{2}>$') THEN 1 ELSE 0 END) AS BIGINT) AS byte_rows, sum(CASE WHEN strlen(token) = 1 OR regexp_matches(token, '^<0x[0-9A-F]{2}>$') THEN 1 ELSE 0 END) / count(*)::DOUBLE AS share FROM slot_vocab WHERE slot IS NOT NULL GROUP BY slot",
        "encode_with_bos_eos": f"SELECT doc_id, CAST(len(ids) + 2 AS BIGINT) AS tokens, md5(concat('1 ', array_to_string(ids, ' '), ' 2')) AS ids FROM {byte_ids}",
        "decode_skip_specials": f"SELECT doc_id, md5(text) AS digest FROM {FILLED}",
        "pad_batch": f"SELECT doc_id, doc_id // 32 AS batch, CAST(max(strlen(text)) OVER (PARTITION BY doc_id // 32) AS BIGINT) AS width, CAST(strlen(text) AS BIGINT) AS attended FROM {FILLED}",
        "lm_windows": f"SELECT doc_id, start, least(start + 257, n) - start - 1 AS scored FROM (SELECT doc_id, n, unnest(range(0, n - 1, 256)) AS start FROM (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM {FILLED}) WHERE n >= 2)",
        "shard_plan": f"WITH p AS (SELECT n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM (SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS n FROM {FILLED})), c AS (SELECT n, o, unnest(range(o // 100000, (o + n - 1) // 100000 + 1)) AS shard FROM p) SELECT shard, count(*) AS pieces, CAST(sum(least(o + n, (shard + 1) * 100000) - greatest(o, shard * 100000)) AS BIGINT) AS tokens FROM c GROUP BY shard",
        "bpb_ngram": f"WITH b AS (SELECT doc_id % 2 AS half, {BYTES} AS b FROM {TEXTS}), p AS (SELECT half, b[i] AS a, b[i + 1] AS b FROM (SELECT half, b, unnest(range(1, len(b))) AS i FROM b)), c AS (SELECT half, a, b, count(*) AS n FROM p GROUP BY ALL), f AS (SELECT a, b, n AS k FROM c WHERE half = 0), t AS (SELECT a, sum(k) AS total FROM f GROUP BY a) SELECT CAST(sum(n) AS BIGINT) AS scored_tokens, round(sum(-ln((coalesce(k, 0) + 1)::DOUBLE / (coalesce(total, 0) + 256)::DOUBLE) * n) / ln(2.0) / sum(n), 6) AS bits_per_byte FROM c LEFT JOIN f USING (a, b) LEFT JOIN t USING (a) WHERE half = 1",
        "per_slot_metrics": f"WITH {leading} SELECT *, bytes AS tokens, CASE WHEN chars > 0 THEN bytes::DOUBLE / chars END AS tokens_per_char, CASE WHEN bytes > 0 THEN chars::DOUBLE / bytes END AS chars_per_token, CASE WHEN bytes > 0 THEN 1.0::DOUBLE END AS bytes_per_token FROM (SELECT slot, count(*) AS runs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM runs GROUP BY slot)",
        "corpus_metrics": f"SELECT *, tokens::DOUBLE / words AS tokens_per_word, tokens::DOUBLE / chars AS tokens_per_char FROM (SELECT count(*) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS tokens, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len({WORDS})) AS BIGINT) AS words FROM {TEXTS})",
        "roundtrip_report": f"SELECT count(*) AS documents, count(*) FILTER (decode(encode(text)) = text) AS exact, CAST(sum(strlen(text)) AS BIGINT) AS total_ids, count(*) FILTER (decode(encode(text)) <> text) AS failures FROM {TEXTS}",
        "gates": f"SELECT 'roundtrip' AS gate, count(*) FILTER (decode(encode(text)) <> text) = 0 AS passed FROM {TEXTS} UNION ALL SELECT 'id_space', count(*) FILTER (r.name IS NULL) = 0 FROM (SELECT range AS id FROM range(5, (SELECT max(end_id) FROM slot_ranges))) i LEFT JOIN slot_ranges r ON {slot_of_id} UNION ALL SELECT 'layout', count(*) FILTER (start_id <> before OR end_id <= start_id OR end_id - start_id <> size) = 0 FROM (SELECT *, coalesce(lag(end_id) OVER (ORDER BY start_id, name), 5) AS before FROM slot_ranges)",
        "bpe_train_pairs": f"WITH {leading}, b AS (SELECT slot, {BYTES} AS b FROM runs) SELECT slot, b[i] AS first, b[i + 1] AS second, count(*) AS n FROM (SELECT slot, b, unnest(range(1, len(b))) AS i FROM b) GROUP BY ALL",
        "unigram_seed_pieces": f"WITH {leading}, k AS (SELECT slot, text FROM runs WHERE slot = 'KANNADA'), i AS (SELECT slot, text, unnest(range(1, length(text) + 1)) AS i FROM k), p AS (SELECT slot, text, i, unnest(range(1, least(3, length(text) - i + 1) + 1)) AS n FROM i) SELECT slot, substring(text, i, n) AS piece, count(*) AS n FROM p GROUP BY ALL",
        "fallback_chars": f"WITH {leading}, c AS (SELECT slot, unnest(string_split(text, '')) AS ch FROM runs), k AS (SELECT DISTINCT slot, token AS ch FROM slot_vocab WHERE slot IS NOT NULL AND slot <> 'CATCHALL' AND length(token) = 1) SELECT c.slot, count(*) AS chars, count(*) FILTER (k.ch IS NULL) AS uncovered FROM c LEFT JOIN k ON c.slot = k.slot AND c.ch = k.ch GROUP BY c.slot",
        "budget_allocation": f"""WITH {leading}, w AS (SELECT slot, pow(sum(strlen(text))::DOUBLE, 0.7) AS w FROM runs WHERE slot <> 'CATCHALL' GROUP BY slot),
            p AS (SELECT slot, CAST(round_even((8000 - 256) * w / (SELECT sum(w) FROM w), 0) AS INT) AS n FROM w), m AS (SELECT arg_max(slot, n) AS slot, 7744 - sum(n) AS drift FROM p)
            SELECT p.slot, CAST(p.n + CASE WHEN p.slot = m.slot THEN m.drift ELSE 0 END AS INT) AS rows FROM p, m UNION ALL SELECT 'CATCHALL', 256""",
        "corpus_registry": "SELECT name, unnest(paths) AS path, string_split(glob_pattern, '/')[-1] AS pattern, regexp_replace(lower(encoding), '[^a-z0-9]', '', 'g') AS encoding, weight FROM corpus_entries",
        "documents_json_roundtrip": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, kind, md5(text) AS digest FROM {TEXTS}",
        "artifact_verify": "SELECT unnest(['vocab', 'layout', 'merges', 'texts']) AS part, NULL::VARCHAR AS problem",
    }
