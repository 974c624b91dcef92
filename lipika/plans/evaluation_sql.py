"""Equivalent SQL of the queries in ``evaluation``, for DuckDB on the same tables. Written from the definitions."""

from __future__ import annotations

from ..operators import generator, language_model
from .oracle import BYTES, FILLED, TEXTS, WORD_SPLIT, WORDS, runs

LINES = """numbered AS (SELECT doc_id, source, text, row_number() OVER (ORDER BY doc_id) AS line_no FROM documents),
    lines AS (SELECT line_no, doc_id, source, CASE WHEN doc_id % 11 <> 0 THEN text END AS text, doc_id % 7 = 3 AS broken FROM numbered)"""


def chars_of(source: str, keys: str, most: int = 1 << 30) -> str:
    """CTE coded(keys, ch_pos, ids): the characters of the composed texts with their ids in the character codec."""
    return f"""single AS (SELECT token, min(id) AS id FROM slot_vocab WHERE length(token) = 1 AND id < {most} GROUP BY token),
    composed AS (SELECT {keys}, nfc_normalize(text) AS text FROM {source} WHERE text <> ''),
    letters AS (SELECT {keys}, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS ch_pos FROM composed),
    coded AS (SELECT {keys}, ch, ch_pos, CASE WHEN v.id IS NOT NULL THEN [v.id] ELSE list_transform(regexp_extract_all(hex(encode(ch)), '..'), lambda x: CAST(concat('0x', x) AS INTEGER) + first_byte) END AS ids
        FROM letters CROSS JOIN (SELECT start_id AS first_byte FROM slot_ranges WHERE name = 'CATCHALL') LEFT JOIN single v ON v.token = letters.ch)"""


STREAMS = f"{chars_of(TEXTS, 'doc_id')}, streams AS (SELECT doc_id, flatten(list(ids ORDER BY ch_pos)) AS ids FROM coded GROUP BY doc_id)"


def bits(seed: int) -> str:
    """CTEs that give one row for a seed: bits per byte and perplexity of the bigram and the unigram model over bytes."""
    k = language_model.BACK_OFF
    return f"""SELECT {seed} AS seed, * FROM (WITH side AS (SELECT text, {BYTES} AS b, md5(concat('{seed}:', doc_id)) < '8' AS held FROM {TEXTS}),
        size AS (SELECT sum(strlen(text)) AS bytes FROM side WHERE held),
        pairs AS (SELECT held, b[i] AS a, b[i + 1] AS b, count(*) AS n FROM (SELECT held, b, unnest(range(1, len(b))) AS i FROM side) GROUP BY ALL),
        own AS (SELECT b, sum(n) AS own FROM pairs WHERE NOT held GROUP BY b), first AS (SELECT a, sum(n) AS first FROM pairs WHERE NOT held GROUP BY a),
        p AS (SELECT h.n, (coalesce(o.own, 0) + 1) / ((SELECT sum(n) FROM pairs WHERE NOT held) + 256.0) AS p1, coalesce(f.n, 0) AS pair, coalesce(t.first, 0) AS first
            FROM (SELECT * FROM pairs WHERE held) h LEFT JOIN (SELECT * FROM pairs WHERE NOT held) f ON h.a = f.a AND h.b = f.b LEFT JOIN own o ON h.b = o.b LEFT JOIN first t ON h.a = t.a),
        cost AS (SELECT sum(n) AS n, sum(-ln(p1) * n) AS one, sum(-ln((pair + {k} * p1) / (first + {k})) * n) AS two FROM p)
        SELECT two / ln(2) / bytes AS part_bpb, one / ln(2) / bytes AS base_bpb, exp(two / n) AS part_perplexity, exp(one / n) AS base_perplexity, (one - two) / ln(2) / bytes AS delta FROM cost, size)"""


SEEDS = " UNION ALL ".join(bits(s) for s in (1, 2, 3))


def synthetic(words: int, seed: int, prefix: str) -> str:
    def number(digest: str, at: int) -> str:
        return f"CAST(concat('0x', substr({digest}, {1 + 4 * at}, 4)) AS BIGINT)"

    def listed(bank: tuple[str, ...]) -> str:
        return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in bank) + "]"

    def pick(bank: int, at: int) -> str:
        return "CASE kind " + " ".join(f"WHEN '{k}' THEN {listed(g[bank])}[1 + {number('digit', at)} % {len(g[bank])}]" for k, g in generator.GRAMMAR.items()) + " END"

    kind = "CASE " + " ".join(f"WHEN share < {upto} THEN '{name}'" for name, upto in generator.KINDS[:-1]) + f" ELSE '{generator.KINDS[-1][0]}' END"
    text = pick(0, 0)
    for bank in (1, 2, 3):
        text = f"replace({text}, '{{{bank - 1}}}', {pick(bank, bank)})"
    text = f"replace({text}, '{{n}}', CAST({number('digit', 4)} % {generator.NUMBERS} AS VARCHAR))"
    return f"""WITH rows AS (SELECT range AS id, concat('{seed}:', range) AS key FROM range({words // generator.LEAST_WORDS + 1})),
        kinds AS (SELECT id, key, CAST(concat('0x', substr(md5(concat(key, ':kind')), 1, 8)) AS BIGINT) / 4294967296.0 AS share, 1 + {number("md5(concat(key, ':n'))", 0)} % {generator.SENTENCES} AS n FROM rows),
        each AS (SELECT id, {kind} AS kind, k, md5(concat(key, ':', k)) AS digit FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM kinds)),
        made AS (SELECT id, any_value(kind) AS kind, string_agg({text}, ' ' ORDER BY k) AS text FROM each GROUP BY id),
        sized AS (SELECT *, coalesce(sum(len({WORDS})) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM made)
        SELECT concat('{prefix}-', lpad(CAST(id AS VARCHAR), 9, '0')) AS doc_id, kind, text FROM sized WHERE before < {words}"""


def spaces() -> str:
    rows = ", ".join(f"('{k}', {' * '.join(map(str, sizes))})" for k, *sizes in generator.bank_sizes())
    return f"SELECT kind, CAST(space AS BIGINT) AS space FROM (VALUES {rows}) t(kind, space)"


def evaluation_sql() -> dict[str, str]:
    leading = runs()
    strip = f"regexp_replace(text, '^{WORD_SPLIT}|{WORD_SPLIT}$', '', 'g')"
    extract = f"""WITH {LINES}, read AS (SELECT *, {strip} AS own FROM lines WHERE line_no > 10),
        state AS (SELECT line_no, substr(own, 1, 2000) AS text, CASE WHEN broken THEN 'broken' WHEN text IS NULL THEN 'without' WHEN length(own) < 50 THEN 'short' ELSE 'fits' END AS state FROM read),
        placed AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM state WHERE state = 'fits'),
        taken AS (SELECT * FROM placed WHERE before < 300000)"""
    groups = "WITH {s}, framed AS (SELECT doc_id, list_concat([1], ids, [2]) AS ids FROM streams), flat AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM framed), named AS (SELECT f.*, r.name AS slot FROM flat f LEFT JOIN slot_ranges r ON f.id >= r.start_id AND f.id < r.end_id), marked AS (SELECT *, CASE WHEN pos > 0 AND slot IS NOT DISTINCT FROM lag(slot) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS edge FROM named), grouped AS (SELECT *, sum(edge) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM marked) SELECT doc_id, CAST(min(pos) AS INT) AS first_pos, any_value(slot) AS slot, count(*) AS tokens, md5(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos)) AS ids FROM grouped WHERE slot IS NOT NULL GROUP BY doc_id, grp"
    gain = " UNION ALL ".join(f"SELECT * FROM (WITH {chars_of('(SELECT * FROM documents WHERE lang IS NOT NULL)', 'doc_id, lang', n)} SELECT lang, {n} AS total, CAST(sum(len(ids)) AS BIGINT) AS tokens, count(*) AS chars FROM coded GROUP BY lang)" for n in (500, 1500, 3000, 5000))
    pivot = " UNION ALL ".join(f"SELECT * FROM (WITH {runs(mode)}, {chars_of('runs', 'slot')} SELECT slot, '{mode}' AS mode, CAST(sum(len(ids)) AS BIGINT) AS chars, CAST(sum(strlen(ch)) AS BIGINT) AS bytes FROM coded GROUP BY slot)" for mode in ("leading", "neutral"))
    run_sums = f"WITH {leading}, {chars_of('runs', 'doc_id, slot, run_pos')}"
    digests = f"SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM {TEXTS}"
    name = "replace(lower(trim(source)), '_', '-')"
    stream = f"(SELECT string_agg(concat(h, '0200'), '' ORDER BY doc_id) AS hex FROM (SELECT doc_id, array_to_string(list_transform({BYTES}, lambda v: printf('%02x%02x', (v + 5) % 256, (v + 5) // 256)), '') AS h FROM documents WHERE regexp_matches(text, '[^{WORD_SPLIT[1:-2]}]')))"
    return {
        "synthetic_corpus": synthetic(10_000, 1337, "syn"),
        "synthetic_heldout": synthetic(2_500, 4242, "held"),
        "sentence_space": spaces(),
        "sample_lines": f"WITH placed AS (SELECT doc_id, lang, text, row_number() OVER w AS k, coalesce(sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {TEXTS} WINDOW w AS (PARTITION BY lang ORDER BY doc_id)), j AS (SELECT lang, count(*) AS lines, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM placed WHERE before < 250000 AND k <= 1000 GROUP BY lang) SELECT lang, lines, length(text) AS chars, md5(text) AS digest FROM j",
        "extract_lines": f"{extract} SELECT line_no, md5(text) AS digest, length(text) AS chars FROM taken",
        "extract_counters": f"{extract} SELECT *, (SELECT count(*) FROM taken) AS taken, (SELECT CAST(coalesce(sum(length(text)), 0) AS BIGINT) FROM taken) AS chars FROM (SELECT count(*) AS read, count(*) FILTER (state = 'broken') AS broken, count(*) FILTER (state = 'without') AS without, count(*) FILTER (state = 'short') AS short FROM state)",
        "group_scan": f"WITH {LINES} SELECT source AS name, min(line_no) AS first_line, count(*) AS lines FROM lines WHERE line_no <= 5000 AND source <> '' GROUP BY source",
        "registry_read": f"SELECT e.name, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM {TEXTS} d JOIN corpus_entries e ON e.name = {name} GROUP BY e.name",
        "id_to_token": "SELECT CAST(i.id AS INT) AS id, coalesce(v.token, '<unk>') AS token FROM (SELECT range AS id FROM range(-2, (SELECT max(id) FROM slot_vocab) + 6)) i LEFT JOIN slot_vocab v ON v.id = i.id",
        "alphabet": f"WITH seen AS (SELECT DISTINCT unnest({BYTES}) AS byte FROM {TEXTS}), safe AS (SELECT unnest(list_concat([9, 10, 13], range(32, 127))) AS byte) SELECT CAST(coalesce(s.byte, o.byte) AS INT) AS byte, o.byte IS NOT NULL AS observed FROM safe s FULL JOIN seen o ON s.byte = o.byte",
        "marked_ids": f"WITH {leading}, b AS (SELECT doc_id, run_pos, list_transform({BYTES}, lambda v: v + 5) AS ids FROM runs), j AS (SELECT doc_id, flatten(list(CASE WHEN run_pos > 0 THEN list_concat([4], ids) ELSE ids END ORDER BY run_pos)) AS ids FROM b GROUP BY doc_id) SELECT doc_id, len(ids) AS tokens, md5(array_to_string(ids, ' ')) AS ids FROM j",
        "char_encode": f"WITH {STREAMS} SELECT doc_id, len(ids) AS tokens, md5(array_to_string(ids, ' ')) AS ids FROM streams",
        "decode_id_groups": groups.format(s=STREAMS),
        "vocab_utilization": f"WITH {STREAMS}, used AS (SELECT DISTINCT unnest(ids) AS id FROM streams) SELECT r.name AS slot, CAST(any_value(r.size) AS BIGINT) AS size, count(u.id) AS used, count(u.id) / any_value(r.size) AS utilization FROM slot_ranges r LEFT JOIN used u ON u.id >= r.start_id AND u.id < r.end_id GROUP BY r.name",
        "marginal_gain": f"SELECT *, (before - fertility) / before * 100 AS gain_pct FROM (SELECT *, lag(fertility) OVER (PARTITION BY lang ORDER BY total) AS before FROM (SELECT *, tokens / chars AS fertility FROM ({gain})))".replace("SELECT *, (before", "SELECT * EXCLUDE (before), (before"),
        "algo_pivot": f"SELECT slot, mode, bytes, chars, CASE WHEN bytes < chars THEN 'bytes' WHEN chars < bytes THEN 'chars' END AS winner, 100.0 * (greatest(bytes, chars) - least(bytes, chars)) / greatest(bytes, chars) AS margin_pct FROM ({pivot})",
        "seed_stats": f"SELECT seed, {', '.join(f'round({c}, 6) AS {c}' for c in ('part_bpb', 'base_bpb', 'part_perplexity', 'base_perplexity', 'delta'))} FROM ({SEEDS})",
        "seed_summary": f"SELECT count(*) AS seeds, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('part_bpb', 'base_bpb', 'delta'))}, round(stddev_samp(delta), 6) AS spread, abs(avg(delta)) > stddev_samp(delta) AS decisive, CASE WHEN abs(avg(delta)) <= stddev_samp(delta) THEN 'inconclusive' WHEN avg(delta) > 0 THEN 'part' ELSE 'base' END AS winner FROM ({SEEDS})",
        "lm_parameters": "SELECT CAST(w AS INT) AS width, CAST(n AS INT) AS layers, (SELECT max(end_id) FROM slot_ranges) * w + 256 * w + n * (12 * w * w + 13 * w) + 2 * w AS parameters FROM (VALUES (128), (256)) a(w), (VALUES (2), (4)) b(n)",
        "lm_sample": f"SELECT doc_id, CAST(start AS INT) AS start FROM (SELECT doc_id, unnest(range(0, len(b) - 256)) AS start FROM (SELECT doc_id, {BYTES} AS b FROM {FILLED}) WHERE len(b) > 256) ORDER BY md5(concat('1337:', doc_id, ':', start)) LIMIT 200",
        "metrics_rounded": f"{run_sums}, s AS (SELECT slot, count(DISTINCT (doc_id, run_pos)) AS runs, count(*) AS chars, CAST(sum(strlen(ch)) AS BIGINT) AS bytes, CAST(sum(len(ids)) AS BIGINT) AS tokens FROM coded GROUP BY slot) SELECT *, round(tokens / chars, 4) AS tokens_per_char, round(chars / tokens, 4) AS chars_per_token, round(bytes / tokens, 4) AS bytes_per_token FROM s",
        "decode_digests": digests,
        "decode_marks": f"WITH {leading} SELECT d.doc_id, md5(coalesce(string_agg(r.text, '<mask>' ORDER BY r.run_pos), '')) AS digest FROM {TEXTS} d LEFT JOIN runs r ON r.doc_id = d.doc_id GROUP BY d.doc_id",
        "encode_run_rows": f"WITH {leading} SELECT doc_id, run_pos, slot, md5(text) AS digest FROM runs",
        "roundtrip_encoded": f"SELECT count(*) AS documents, count(*) AS exact, 0::BIGINT AS failures, 0::BIGINT AS special_ids, '' AS examples FROM {TEXTS}",
        "layout_roundtrip": "SELECT name, start_id, end_id, algorithm, size FROM slot_ranges",
        "frozen_describe": "SELECT r.name, r.start_id, r.end_id, r.algorithm, array_to_string(coalesce(s.scripts, []), ',') AS scripts, s.structural, s.trained FROM slot_ranges r JOIN slot_specs s ON r.name = s.name",
        "shard_files": f"WITH s AS (SELECT hex FROM {stream} t), k AS (SELECT unnest(range(0, CAST(ceil(length(hex) / 400000.0) AS BIGINT))) AS shard FROM s), p AS (SELECT shard, substr(hex, CAST(shard * 400000 + 1 AS BIGINT), 400000) AS h FROM k, s) SELECT concat('shard_', lpad(CAST(shard AS VARCHAR), 5, '0'), '.bin') AS filename, length(h) // 4 AS tokens, sha256(unhex(h)) AS digest FROM p",
        "sql_functions": f"WITH {leading}, n AS (SELECT doc_id, count(*) AS runs FROM runs GROUP BY doc_id) SELECT d.doc_id, md5(nfc_normalize(text)) AS nfc, CAST(coalesce(n.runs, 0) AS INT) AS runs, md5(nfc_normalize(text)) AS decoded FROM {TEXTS} d LEFT JOIN n ON d.doc_id = n.doc_id",
        "build_gates": "SELECT gate, true AS passed FROM (VALUES ('roundtrip'), ('id_space'), ('layout'), ('manifest')) t(gate)",
    }
