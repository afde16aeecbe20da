"""One SQL statement per registered query that SQL can restate."""

from __future__ import annotations

from logtriage.functions import signature as G
from logtriage.operators import evaluation as E
from logtriage.operators import ingest as I
from logtriage.operators.detect import DISPLAY_NAMES
from logtriage.plans import queries as P
from logtriage.plans import reports as R
from logtriage.plans import request_logs as Q
from logtriage.plans import templates as T
from logtriage.schema import DATASET_COLUMNS, REQUIRED_SPLITS, SIGNAL_KEYS, TRAINING_SPLITS
from logtriage.sources.alerts import RECOMMENDATION
from oracle.base import (
    MODELS,
    RULES,
    WS,
    Chain,
    add_canonical,
    add_comparison,
    add_logs,
    add_signature,
    canon,
    cleanup_sql,
    compared,
    detected,
    entities_sql,
    errors,
    label_sql,
    lit,
    logs,
    pick,
    predicted,
    re_,
    risk_sql,
    scored,
    signed,
    unicode_sql,
    values,
    zip_text,
)

ORACLES: dict[str, str] = {}
DAY = P.DAY
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, {lit('^' + WS + '+')}, ''), {lit(WS + '+$')}, '')"


# -- scans and text functions -----------------------------------------------------------------------


def document_lines(keys: str) -> Chain:
    chain = Chain()
    chain.add("whole", f"SELECT {keys}, string_split_regex(text, {lit(BREAKS)}) AS parts, text FROM documents")
    chain.add(
        "pieces",
        f"""SELECT {keys}, CASE WHEN text IS NULL OR text = '' THEN [] WHEN parts[-1] = '' THEN parts[1:len(parts) - 1]
        ELSE parts END AS parts FROM whole""",
    )
    chain.add(
        "numbered",
        f"SELECT {keys}, unnest(generate_series(1, len(parts)))::INT AS line, unnest(parts) AS raw_log FROM pieces",
    )
    return chain


ORACLES["scan_lines"] = document_lines("doc_id").sql(
    f"SELECT doc_id, line, raw_log FROM numbered WHERE {strip_sql('raw_log')} <> ''"
)
ORACLES["indicators"] = document_lines("source, doc_id").sql(
    f"""SELECT s.source, s.rows, coalesce(p.preview, '') AS indicator_preview
    FROM (SELECT source, count(*) AS rows FROM numbered GROUP BY source) s
    LEFT JOIN (SELECT source, string_agg(ind, '|' ORDER BY rn) AS preview FROM (
      SELECT source, {strip_sql('raw_log')} AS ind, row_number() OVER (PARTITION BY source ORDER BY doc_id, line) AS rn
      FROM numbered WHERE {strip_sql('raw_log')} <> '' AND NOT starts_with(lower(raw_log), 'uuid')
      AND NOT starts_with(lower(raw_log), 'event') AND NOT starts_with(lower(raw_log), 'type')) WHERE rn <= 5
      GROUP BY source) p USING (source)"""
)
ORACLES["split_filter"] = logs().sql("SELECT log_id, split, raw_log FROM request_logs WHERE split = 'val'")
ORACLES["missing_splits"] = logs().sql(
    f"""SELECT split FROM {values([(s,) for s in REQUIRED_SPLITS], ['split'])}
    WHERE split NOT IN (SELECT split FROM request_logs)"""
)
ORACLES["split_counts"] = logs().sql("SELECT split, count(*) AS rows FROM request_logs GROUP BY split")
ORACLES["percent_decode"] = logs().sql("SELECT log_id, url_decode(raw_log) AS decoded FROM request_logs")
ORACLES["url_passes"] = canon().sql("SELECT log_id, c_d4 AS decoded, c_passes::INT AS passes FROM canon")
ORACLES["html_numeric"] = logs().sql(f"SELECT log_id, {entities_sql('raw_log')} AS decoded FROM request_logs")
ORACLES["html_pages"] = f"SELECT page_id, {entities_sql('html')} AS decoded FROM pages"
ORACLES["unicode_unescape"] = logs().sql(f"SELECT log_id, {unicode_sql('raw_log')} AS decoded FROM request_logs")


def resolved() -> Chain:
    """Eight rounds; the two case rules change the case of what they keep."""
    chain = logs().add("r0", "SELECT log_id, raw_log AS t FROM request_logs")
    last = "r0"
    for number in range(1, 9):
        for tag, rule, change in (("a", RULES[0], "lower"), ("b", RULES[1], "upper")):
            fills = f"list_transform(regexp_extract_all(t, {lit(rule)}, 1), lambda x: {change}(x))"
            name = f"r{number}{tag}"
            chain.add(name, f"SELECT log_id, {zip_text(f'string_split_regex(t, {lit(rule)})', fills)} AS t FROM {last}")
            last = name
        rest = "t"
        for rule in RULES[2:]:
            rest = rf"regexp_replace({rest}, {lit(rule)}, '\1', 'g')"
        chain.add(f"r{number}", f"SELECT log_id, {rest} AS t FROM {last}")
        last = f"r{number}"
    return chain


ORACLES["resolve_lookups"] = resolved().sql("SELECT log_id, t AS resolved FROM r8")
ORACLES["cleanup"] = f"SELECT doc_id, {cleanup_sql('text')} AS cleaned FROM documents"
ORACLES["percent_encode"] = logs().sql("SELECT log_id, url_encode(url_encode(raw_log)) AS encoded FROM request_logs")


def nested_replace(c: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        c = f"replace({c}, {lit(old)}, {lit(new)})"
    return c


U_PAIRS = [("$", "%u0024"), ("{", "%u007B"), ("}", "%u007D"), (":", "%u003A"), ("/", "%u002F")]
ENTITY_PAIRS = [("$", "&#36;"), ("{", "&#123;"), ("}", "&#125;"), (":", "&#58;"), ("/", "&#47;")]
ORACLES["percent_u_encode"] = logs().sql(
    f"SELECT log_id, {nested_replace('raw_log', U_PAIRS)} AS encoded FROM request_logs"
)
ORACLES["entity_encode"] = logs().sql(
    f"SELECT log_id, {nested_replace('raw_log', ENTITY_PAIRS)} AS encoded FROM request_logs"
)
ORACLES["base64"] = "SELECT doc_id, to_base64(encode(text)) AS encoded FROM documents"

# -- canonical form and signals -----------------------------------------------------------------------

PATTERNS = "array_to_string(detected_patterns, '|')"
ORACLES["canonicalize"] = canon().sql(
    f"""SELECT log_id, normalized_log, {PATTERNS} AS detected_patterns, canonical_type AS obfuscation_type FROM canon"""
)
ORACLES["canonicalize_texts"] = add_canonical(
    Chain().add(
        "texts",
        """SELECT 'document' AS kind, doc_id AS key, 0 AS turn, text FROM documents UNION ALL
        SELECT 'turn', conv_id, turn::INT, text FROM conversations""",
    ),
    "texts",
    "canon",
    "text",
).sql("SELECT kind, key, turn, md5(normalized_log) AS normalized_md5, canonical_type AS obfuscation_type FROM canon")
ORACLES["signals"] = canon().sql(f"SELECT log_id, {', '.join(SIGNAL_KEYS)}, {PATTERNS} AS patterns FROM canon")
ORACLES["obfuscation_type"] = canon().sql(
    "SELECT family, canonical_type AS obfuscation_type, count(*) AS rows FROM canon GROUP BY ALL"
)
ORACLES["signal_vector"] = canon().sql(
    f"SELECT log_id, concat_ws('|', {', '.join(f'{k}::INT' for k in SIGNAL_KEYS)}) AS vector FROM canon"
)

# -- detection ------------------------------------------------------------------------------------------

ORACLES["signature_matches"] = signed().sql("SELECT log_id, array_to_string(matched, '|') AS matched FROM signed")
ORACLES["signature_score"] = signed().sql("SELECT log_id, sig_score FROM signed")
ORACLES["signature_label"] = signed().sql(
    """SELECT family, (sig_score >= 0.3::DOUBLE)::INT AS label_at_30, (sig_score >= 0.45::DOUBLE)::INT AS label_at_45,
    (sig_score >= 0.7::DOUBLE)::INT AS label_at_70, (sig_score >= 0.95::DOUBLE)::INT AS label_at_95, count(*) AS rows
    FROM signed GROUP BY ALL"""
)
ORACLES["risk_bands"] = scored().sql(
    f"""SELECT log_id, score_raw, {risk_sql('score_raw')} AS risk_level, {label_sql('score_raw')} AS label_band
    FROM scored"""
)
ORACLES["explain"] = detected().sql("SELECT family, label, explanation, count(*) AS rows FROM detected GROUP BY ALL")
ORACLES["detect"] = detected().sql(
    f"""SELECT log_id, label, score, risk_level, normalized_log, {PATTERNS} AS detected_patterns, explanation,
    score AS signature_score, 1::INT AS model_count, NULL::DOUBLE AS latency_ms FROM detected"""
)
ORACLES["detect_by_family"] = detected().sql(
    "SELECT family, risk_level, count(*) AS lines, round(avg(score), 6) AS avg_score FROM detected GROUP BY ALL"
)
ORACLES["model_fallback"] = scored().sql(
    """SELECT log_id, coalesce(n, r, score_signature) AS asked_normalized, coalesce(r, score_signature) AS asked_missing,
    score_signature AS asked_signature, (1 + (n IS NOT NULL)::INT + (r IS NOT NULL)::INT)::INT AS model_count
    FROM (SELECT *, CASE WHEN log_id % 2 = 0 THEN score_normalized END AS n,
          CASE WHEN log_id % 3 = 0 THEN score_raw END AS r FROM scored)"""
)
_LONG = " UNION ALL ".join(
    f"""SELECT log_id, '{m}' AS model, {lit(DISPLAY_NAMES[m])} AS detector, round(score_{m}, 6) AS score,
    {0.7 if m == 'signature' else 0.49999999999999994 if m == 'raw' else 0.5}::DOUBLE AS threshold FROM scored"""
    for m in MODELS
)
ORACLES["score_table"] = (
    scored()
    .add("long", _LONG)
    .sql(
        """SELECT *, CASE WHEN score >= threshold THEN 'malicious' ELSE 'benign' END AS decision,
        CASE WHEN model = 'raw' THEN 'final detector' ELSE 'comparison signal' END AS role FROM long"""
    )
)
_ALERT = "risk_level IN ('suspicious', 'critical')"
ORACLES["alerts"] = detected().sql(
    f"""SELECT log_id, CASE risk_level WHEN 'critical' THEN '[CRITICAL]' ELSE '[SUSPICIOUS]' END AS status,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, label, score AS risk_score, risk_level, raw_log, normalized_log,
    {PATTERNS} AS detected_patterns, {lit(RECOMMENDATION)} AS recommendation FROM detected WHERE {_ALERT}"""
)
ORACLES["alert_kpis"] = detected().sql(
    f"""SELECT count(*) AS stored_alerts, count(*) FILTER (risk_level = 'critical') AS critical_alerts
    FROM detected WHERE {_ALERT}"""
)
ORACLES["alert_tail"] = detected().sql(
    f"SELECT log_id, risk_level, raw_log FROM detected WHERE {_ALERT} ORDER BY ts DESC, log_id DESC LIMIT 50"
)
ORACLES["stream_detect"] = detected().sql(
    """SELECT log_id, label, score, risk_level, CASE risk_level WHEN 'critical' THEN '[CRITICAL]'
    WHEN 'suspicious' THEN '[SUSPICIOUS]' ELSE '[OK]' END AS status, normalized_log FROM detected"""
)
ORACLES["stream_alerts"] = detected().sql(
    f"SELECT label, risk_level, score AS risk_score, count(*) AS rows FROM detected WHERE {_ALERT} GROUP BY ALL"
)

# -- feeds ------------------------------------------------------------------------------------------------


def add_feed(chain: Chain) -> Chain:
    b = "\\"
    quoted = f"replace(replace(raw_log, {lit(b)}, {lit(b * 2)}), '\"', {lit(b + chr(34))})"
    hidden = f"replace({quoted}, '$', {lit(b + 'u0024')})"
    head = lit('2021-12-15T16:12:36Z",1,"')
    mid = lit('","logstash",,"_doc","')
    return chain.add(
        "feed",
        f"""SELECT log_id + 1 AS line, tpl_id, log_id % 5 AS shape, raw_log AS inner_text, CASE
        WHEN log_id % 5 = 0 THEN {head} || log_id || {mid} || raw_log || '"'
        WHEN log_id % 5 = 1 THEN '{{"seen":1,"event":{{"message":"' || {quoted} || '"}}}}'
        WHEN log_id % 5 = 2 THEN raw_log
        WHEN log_id % 5 = 3 AND tpl_id < 4 THEN {lit(Q.FEED_HEADER)}
        WHEN log_id % 5 = 3 THEN '{{"payload":"' || {hidden} || '","n":1}}'
        ELSE '["row",{{"request":"' || {hidden} || '"}}]' END AS raw_log FROM request_logs""",
    )


def feed() -> Chain:
    return add_feed(logs())


_IS_HEADER = f"raw_log = {lit(Q.FEED_HEADER)}"
ORACLES["header_filter"] = feed().sql(f"SELECT line, {_IS_HEADER} AS is_header FROM feed")
_SHAPED = " OR ".join(f"starts_with(lower({{c}}), {lit(p)})" for p in I.REQUEST_PREFIXES)
ORACLES["request_shape"] = feed().sql(
    f"SELECT line, ({_SHAPED.format(c=strip_sql('raw_log'))}) AS is_request FROM feed"
)
_CANDIDATES = """SELECT line, 0::INT AS pos, raw_log AS candidate FROM feed
    UNION ALL SELECT line, 1, json_extract_string(raw_log, '$.event.message') FROM feed WHERE shape = 1
    UNION ALL SELECT line, 1, json_extract_string(raw_log, '$.payload') FROM feed WHERE shape = 3 AND tpl_id >= 4
    UNION ALL SELECT line, 1, 'row' FROM feed WHERE shape = 4
    UNION ALL SELECT line, 2, json_extract_string(raw_log, '$[1].request') FROM feed WHERE shape = 4"""
ORACLES["flatten_json"] = feed().sql(_CANDIDATES)

_P1 = lit(r"""(?i)(%24%7b[^\s"',]+)""")
_P2 = lit(r"""(?i)(\$\{[^\s"',]*(?:jndi|ldap://|rmi://|dns://|ldaps://|lower:|upper:|env:|::-|:-)[^\s"',]*\})""")


def add_tokens(chain: Chain, source: str, key: str, text: str) -> Chain:
    """First accepted token per key: ``tokens_first(key..., token)``."""
    chain.add(
        "token_lists",
        f"""SELECT {key}, list_concat(regexp_extract_all({text}, {_P1}, 1), regexp_extract_all({text}, {_P2}, 1)) AS ts
        FROM {source}""",
    )
    chain.add(
        "token_rows",
        f"SELECT {key}, unnest(generate_series(1, len(ts))) AS token_pos, unnest(ts) AS token FROM token_lists",
    )
    add_canonical(chain, "token_rows", "token_canon", "token")
    return chain.add(
        "tokens_first",
        f"""SELECT {key}, arg_min(token, token_pos) AS token FROM token_canon
        WHERE has_jndi AND (has_ldap OR has_rmi OR has_dns OR has_ldaps) GROUP BY {key}""",
    )


ORACLES["extract_token"] = add_tokens(logs(), "request_logs", "log_id", "raw_log").sql(
    "SELECT log_id, token FROM request_logs LEFT JOIN tokens_first USING (log_id)"
)


def add_observations(chain: Chain) -> Chain:
    """``observations(line, observation)`` over ``feed``."""
    chain.add("cands0", _CANDIDATES)
    chain.add("cands", f"SELECT line, pos, {strip_sql('candidate')} AS candidate FROM cands0")
    add_tokens(chain, "cands", "line, pos", "candidate")
    shaped = _SHAPED.format(c="candidate")
    chain.add(
        "found",
        f"""SELECT line, pos, CASE WHEN ({shaped}) THEN candidate
        ELSE 'Request from User-Agent: ' || token || ' | Method: GET | Host: external-feed | Path: /' END AS observation
        FROM cands JOIN tokens_first USING (line, pos) WHERE candidate <> {lit(Q.FEED_HEADER)}""",
    )
    return chain.add(
        "observations", "SELECT line, arg_min(observation, pos) AS observation FROM found GROUP BY line"
    )


ORACLES["extract_observation"] = add_observations(feed()).sql(
    "SELECT line, observation FROM feed LEFT JOIN observations USING (line)"
)
_FIRST = "SELECT observation, min(line) AS first_seen FROM observations GROUP BY observation ORDER BY 2"
ORACLES["first_distinct"] = add_observations(feed()).sql(f"{_FIRST} LIMIT 80")


def record_select(**columns: str) -> str:
    return ", ".join(f"{columns[c]} AS {c}" for c in DATASET_COLUMNS)


_IMPORT = add_observations(feed()).add("seen", "SELECT line, observation AS raw_log FROM observations")
ORACLES["import_feed"] = add_canonical(_IMPORT, "seen", "canon").sql(
    "SELECT "
    + record_select(
        id="'GB-' || lpad(line::VARCHAR, 6, '0')",
        timestamp=lit(DAY),
        source="'greedybear_log4pot'",
        raw_log="raw_log",
        normalized_log="normalized_log",
        label="1::INT",
        attack_family="'log4shell'",
        obfuscation_type="canonical_type",
        field="'honeypot_feed'",
        split="'external_greedybear_test'",
        risk_level="'critical'",
    )
    + " FROM canon"
)


def packets() -> Chain:
    return logs().add(
        "packets",
        """SELECT log_id + 1 AS line, CASE WHEN log_id % 3 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '' END AS frame_time,
        'Request from 10.0.0.' || (user_id % 250) || ' User-Agent: ' || CASE WHEN tpl_id % 2 = 0 THEN raw_log ELSE '' END
        || ' | Method: GET | Host: ' || host || ' | Path: ' || CASE WHEN tpl_id % 2 = 0 THEN '/' ELSE '/?q=' || raw_log END
        AS raw_log FROM request_logs""",
    )


ORACLES["import_requests"] = add_canonical(packets(), "packets", "canon").sql(
    "SELECT "
    + record_select(
        id="'FX-' || lpad(line::VARCHAR, 6, '0')",
        timestamp=f"CASE WHEN frame_time = '' THEN {lit(DAY)} ELSE frame_time END",
        source="'foxit_pcap_http'",
        raw_log="raw_log",
        normalized_log="normalized_log",
        label="has_jndi::INT",
        attack_family="CASE WHEN has_jndi THEN 'log4shell' ELSE 'benign' END",
        obfuscation_type="canonical_type",
        field="'pcap_http'",
        split="'external_foxit_pcap_test'",
        risk_level="CASE WHEN has_jndi THEN 'critical' ELSE 'low' END",
    )
    + " FROM canon"
)
ORACLES["request_observations"] = add_tokens(packets(), "packets", "line", "raw_log").sql(
    """SELECT raw_log, min(line) AS first_seen FROM packets JOIN tokens_first USING (line)
    GROUP BY raw_log ORDER BY 2 LIMIT 40"""
)
ORACLES["benign_candidates"] = canon().sql(
    f"""SELECT {strip_sql('raw_log')} AS candidate, min(log_id) AS first_seen FROM canon
    WHERE NOT has_jndi AND {strip_sql('raw_log')} <> '' GROUP BY 1 ORDER BY 2 LIMIT 200"""
)
_FEEDS = f"""SELECT observation AS raw_log, 'honeypot' AS source FROM ({_FIRST})
    UNION ALL SELECT raw_log, 'simulation_fallback' FROM
    {values([(t,) for t in T.FEED_FALLBACKS['simulation']], ['raw_log'])}
    WHERE NOT EXISTS (SELECT 1 FROM conversations WHERE contains(lower(text), 'jndi'))"""
ORACLES["feed_fallback"] = add_observations(feed()).sql(_FEEDS)
ORACLES["source_meta"] = add_observations(feed()).sql(
    f"""SELECT s.source, count(f.source) AS rows, coalesce(any_value(ends_with(f.source, '_fallback')), false) AS used_fallback
    FROM (VALUES ('honeypot'), ('simulation')) s(source)
    LEFT JOIN ({_FEEDS}) f ON f.source IN (s.source, s.source || '_fallback') GROUP BY s.source"""
)

# -- corpus -------------------------------------------------------------------------------------------------


def add_hosts(chain: Chain) -> Chain:
    return chain.add(
        "hosts",
        "SELECT min(page_id) AS host_no, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages GROUP BY 2",
    )


def add_payloads(chain: Chain, name: str, rows: list[tuple], extra: str = "") -> Chain:
    table = values([(i, *r) for i, r in enumerate(rows)], ["tpl_no", "tpl", "passes", "family"])
    p = "replace(tpl, '{h}', host)"
    enc = f"CASE passes WHEN 0 THEN {p} WHEN 1 THEN url_encode({p}) WHEN 2 THEN url_encode(url_encode({p})) "
    enc += f"ELSE url_encode(url_encode(url_encode({p}))) END"
    return chain.add(
        name,
        f"""SELECT host_no, host, tpl_no::INT AS tpl_no, family, {enc} AS payload, sample_no::INT AS sample_no {extra}
        FROM hosts, {table}, range(0, {P.EXPANSION_SAMPLES}) s(sample_no)""",
    )


def add_context(chain: Chain, name: str, source: str) -> Chain:
    whole = ", ".join(lit(f) for f in T.WHOLE_LINE_FAMILIES)
    field = f"CASE WHEN family IN ({whole}) THEN 'context' ELSE {pick(T.FIELDS, f'sample_no % {len(T.FIELDS)}')} END"
    chain.add(f"{name}_f", f"SELECT *, {field} AS field FROM {source}")
    agent = pick(T.USER_AGENTS, f"(sample_no + tpl_no) % {len(T.USER_AGENTS)}")
    path = pick(T.PATHS, f"(sample_no + tpl_no) % {len(T.PATHS)}")
    return chain.add(
        name,
        f"""SELECT *, CASE field WHEN 'minimal_query' THEN 'GET /?q=' || payload || ' HTTP/1.1'
        WHEN 'uri_param' THEN 'GET /api/check?debug=' || payload || ' HTTP/1.1 Host: app.local'
        WHEN 'user_agent' THEN 'Request from User-Agent: ' || payload || ' | Method: GET | Host: app.local | Path: ' || {path}
        WHEN 'user_agent_minimal' THEN 'Request from User-Agent: ' || payload
        WHEN 'x_api_version' THEN 'Request from User-Agent: ' || {agent} || ' | Method: GET | Host: app.local | Path: '
          || {path} || ' | X-Api-Version: ' || payload
        WHEN 'path' THEN 'GET /search?q=' || payload || ' HTTP/1.1 Host: app.local User-Agent: ' || {agent}
        WHEN 'body' THEN 'POST /search HTTP/1.1 Host: app.local Body: query=' || payload
        ELSE payload END AS raw_log FROM {name}_f""",
    )


def synthetic(chain: Chain | None = None) -> Chain:
    chain = add_payloads(chain or add_hosts(Chain()), "syn0", T.MALICIOUS)
    add_context(chain, "syn1", "syn0")
    cases = " ".join(f"WHEN {lit(f)} THEN {lit(s)}" for f, s in T.FAMILY_SPLITS)
    return chain.add("synthetic", f"SELECT *, CASE family {cases} END AS split FROM syn1")


def evasion(chain: Chain | None = None) -> Chain:
    chain = add_payloads(chain or add_hosts(Chain()), "ev_train", T.EVASION_TRAIN, ", 'train' AS split")
    add_payloads(chain, "ev_test", T.EVASION_TEST, ", 'adversarial_evasion_test' AS split")
    chain.add("ev0", "SELECT * FROM ev_train UNION ALL SELECT * FROM ev_test")
    return add_context(chain, "evasion", "ev0")


def add_hard(chain: Chain) -> Chain:
    table = values([(i, *r) for i, r in enumerate(T.HARD_NEGATIVE)], ["tpl_no", "tline", "tpl", "encoding", "family"])
    p = "replace(tpl, '{h}', host)"
    enc = f"""CASE encoding WHEN 'percent' THEN url_encode({p}) WHEN 'percent2' THEN url_encode(url_encode({p}))
    WHEN 'percent_u' THEN {nested_replace(p, U_PAIRS)} WHEN 'entity' THEN {nested_replace(p, ENTITY_PAIRS)}
    WHEN 'base64' THEN to_base64(encode({p})) ELSE {p} END"""
    return chain.add(
        "hard",
        f"""SELECT host_no, tpl_no::INT AS tpl_no, family, replace(tline, '{{p}}', {enc}) AS raw_log,
        row_number() OVER (ORDER BY host_no, tpl_no) - 1 AS pool_no FROM hosts, {table}""",
    )


ORACLES["corpus_expand"] = synthetic().sql("SELECT host_no, tpl_no, sample_no, family, payload FROM synthetic")
ORACLES["contextualize"] = evasion().sql("SELECT host_no, tpl_no, sample_no, split, field, raw_log FROM evasion")
ORACLES["assign_split"] = synthetic().sql("SELECT family, split, count(*) AS rows FROM synthetic GROUP BY ALL")
ORACLES["hard_negatives"] = add_hard(add_hosts(Chain())).sql("SELECT host_no, tpl_no, family, raw_log FROM hard")


def ood() -> Chain:
    chain = add_hosts(Chain())
    attack = values([(i, *r) for i, r in enumerate(T.OOD_MALICIOUS)], ["tpl_no", "tpl", "family"])
    quoted = values([(i, *r) for i, r in enumerate(T.OOD_BENIGN)], ["tpl_no", "tpl", "family"])
    chain.add(
        "ood0",
        " UNION ALL ".join(
            f"""SELECT host_no, host, tpl_no, family, replace(tpl, '{{h}}', host) AS payload, {label}::INT AS label, sample_no
            FROM hosts, {table}, range(0, 4) s(sample_no)"""
            for label, table in ((1, attack), (0, quoted))
        ),
    )
    chain.add(
        "ood1",
        f"""SELECT *, 900000 + row_number() OVER (ORDER BY label DESC, host_no, tpl_no, sample_no) AS number,
        CASE WHEN label = 1 THEN {pick(T.OOD_FIELDS, 'sample_no % 4')} ELSE 'mixed' END AS field FROM ood0""",
    )
    return chain.add(
        "ood",
        """SELECT *, 'OOD-' || lpad(number::VARCHAR, 6, '0') AS id, CASE field
        WHEN 'query' THEN 'GET /api/audit?trace=' || payload || '&request_id=ood-' || number || ' HTTP/1.1 Host: victim.local'
        WHEN 'json' THEN 'POST /ingest HTTP/1.1 Host: victim.local Content-Type: application/json Body: {"ua":"' || payload
          || '","host":"' || host || '"}'
        WHEN 'header' THEN 'Request from User-Agent: Mozilla/5.0 | X-Forwarded-For: 10.0.0.' || (number % 250)
          || ' | X-Api-Version: ' || payload
        WHEN 'cookie' THEN 'GET /profile HTTP/1.1 Host: victim.local Cookie: prefs=light; tracking=' || payload
          || '; sid=ood' || number
        ELSE payload || CASE WHEN sample_no > 0 THEN ' trace_id=benign-ood-' || number ELSE '' END END AS raw_log FROM ood1""",
    )


ORACLES["ood_set"] = ood().sql("SELECT id, label, family, field, raw_log FROM ood")


def corpus() -> Chain:
    chain = evasion(synthetic(add_hosts(Chain())))
    add_hard(chain)
    lines = [t for t in T.BENIGN if t[1] in T.PLAIN_BENIGN_FAMILIES]
    pool = values([(k, *t) for k, t in enumerate(lines)], ["pool_no", "raw_log", "family"])
    chain.add(
        "plain",
        f"""SELECT d.split, d.draw_no, p.raw_log, p.family FROM (
          SELECT split, unnest(range(0, n)) AS draw_no FROM {values(T.PLAIN_QUOTAS, ['split', 'n'])}) d
        JOIN (SELECT * FROM {pool}) p
          ON p.pool_no = ('0x' || substr(md5('42:' || d.split || ':' || d.draw_no), 1, 15))::BIGINT % {len(lines)}""",
    )
    chain.add("blind", f"SELECT * FROM {values(list(enumerate(T.BLIND_LINES)), ['n', 'raw_log'])}")
    chain.add(
        "feed_seen",
        add_observations(feed()).sql("SELECT observation, min(line) AS line FROM observations GROUP BY observation"),
    )
    chain.add(
        "packets_seen",
        add_tokens(packets(), "packets", "line", "raw_log").sql(
            "SELECT raw_log, min(line) AS line FROM packets JOIN tokens_first USING (line) GROUP BY raw_log"
        ),
    )
    return chain.add(
        "corpus",
        f"""SELECT 0 AS source_no, host_no, tpl_no, sample_no, 'synthetic' AS source, 1 AS label, family,
          NULL AS override, field, split, raw_log FROM synthetic
        UNION ALL SELECT 1, host_no, tpl_no, sample_no, 'adversarial_evasion', 1, family, family, field, split, raw_log
          FROM evasion
        UNION ALL SELECT 2, host_no, tpl_no, k, 'hard_negative', 0, family, NULL, 'mixed', sp,
          raw_log || ' trace_id=hardneg-' || sp || '-' || lpad(k::VARCHAR, 4, '0')
          FROM hard, (VALUES (0, 'train'), (1, 'hard_negative_test')) x(k, sp)
        UNION ALL SELECT 3, draw_no, 0, 0, 'benign_logs', 0, family, NULL, 'mixed', split, raw_log FROM plain
        UNION ALL SELECT 4, n, 0, 0, 'blind_manual', 1, 'blind_manual', NULL, 'manual', 'blind_manual_test', raw_log FROM blind
        UNION ALL SELECT 5, line, 0, 0, 'greedybear_log4pot', 1, 'honeypot', NULL, 'honeypot_feed',
          'external_greedybear_test', observation FROM feed_seen
        UNION ALL SELECT 6, line, 0, 0, 'foxit_pcap_http', 1, 'packet', NULL, 'pcap_http', 'external_foxit_pcap_test',
          raw_log FROM packets_seen""",
    )


def record_chain() -> Chain:
    chain = add_canonical(corpus(), "corpus", "canon")
    return chain.add(
        "records",
        f"""SELECT *, {lit(DAY)} AS timestamp, label::INT AS lab,
        coalesce(override, CASE WHEN label = 1 THEN canonical_type ELSE family END) AS obfuscation_type,
        CASE WHEN label = 1 THEN 'log4shell' ELSE 'benign' END AS attack_family,
        CASE WHEN label = 1 THEN 'critical' ELSE 'low' END AS risk_level,
        'LS-' || lpad((row_number() OVER (ORDER BY source_no, split, host_no, tpl_no, sample_no))::VARCHAR, 6, '0') AS id
        FROM canon""",
    )


ORACLES["records"] = record_chain().sql(
    "SELECT " + ", ".join("lab AS label" if c == "label" else c for c in DATASET_COLUMNS) + " FROM records"
)
ORACLES["corpus_stats"] = record_chain().sql(
    """SELECT statistic, value, sum(n)::BIGINT AS rows FROM (
      SELECT 'by_split' AS statistic, split AS value, 1 AS n FROM records
      UNION ALL SELECT 'by_label', lab::VARCHAR, 1 FROM records UNION ALL SELECT 'by_source', source, 1 FROM records
      UNION ALL SELECT 'by_obfuscation_type', obfuscation_type, 1 FROM records
      UNION ALL SELECT 'total_rows', '', 1 FROM records) GROUP BY ALL"""
)
ORACLES["split_matrix"] = corpus().sql(
    """SELECT split, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS malicious
    FROM corpus GROUP BY split"""
)
ORACLES["top_families"] = record_chain().sql(
    """SELECT obfuscation_type, count(*) AS rows FROM records GROUP BY obfuscation_type
    ORDER BY rows DESC, obfuscation_type LIMIT 14"""
)
_HELD = "split IN ('unseen_obfuscation_test', 'adversarial_evasion_test')"
ORACLES["leakage"] = record_chain().sql(
    f"""SELECT 'stored' AS basis, obfuscation_type AS shared_type FROM (
      SELECT obfuscation_type FROM records WHERE split = 'train' INTERSECT SELECT obfuscation_type FROM records WHERE {_HELD})
    UNION ALL SELECT 'recomputed', canonical_type FROM (
      SELECT canonical_type FROM records WHERE split = 'train' INTERSECT SELECT canonical_type FROM records WHERE {_HELD})"""
)
ORACLES["quota_sample"] = add_hard(add_hosts(Chain())).sql(
    f"""SELECT d.split, d.draw_no::INT AS draw_no, family, raw_log FROM (
      SELECT split, unnest(range(0, n)) AS draw_no FROM {values(T.HARD_NEGATIVE_QUOTAS, ['split', 'n'])}) d
    JOIN hard ON hard.pool_no = ('0x' || substr(md5('42:' || d.split || ':' || d.draw_no), 1, 15))::BIGINT
      % (SELECT count(*) FROM hard)"""
)
_HN = add_hard(add_hosts(Chain())).add(
    "drawn",
    """SELECT i, family, raw_log || ' trace_id=standalone-hardneg-' || lpad(i::VARCHAR, 4, '0') AS raw_log
    FROM range(1, 181) r(i) JOIN hard ON hard.pool_no = (i - 1) % (SELECT count(*) FROM hard)""",
)
ORACLES["hard_negative_set"] = add_canonical(_HN, "drawn", "canon").sql(
    "SELECT "
    + record_select(
        id="'HN-' || lpad(i::VARCHAR, 6, '0')",
        timestamp=lit(DAY),
        source="'hard_negative'",
        raw_log="raw_log",
        normalized_log="normalized_log",
        label="0::INT",
        attack_family="'benign'",
        obfuscation_type="family",
        field="'mixed'",
        split="'hard_negative_test'",
        risk_level="'low'",
    )
    + " FROM canon"
)
ORACLES["shuffle"] = logs().sql(
    "SELECT log_id, row_number() OVER (ORDER BY md5('31415:' || log_id), log_id) AS position FROM request_logs"
)
ORACLES["sample_limit"] = logs().sql(
    "SELECT log_id, label FROM request_logs ORDER BY md5('42:' || log_id), log_id LIMIT 500"
)

# -- metrics, evaluation and reports --------------------------------------------------------------------------

_RATES = "accuracy, precision, recall, f1, fpr, fnr"
_COUNTS = "tp, fp, tn, fn, positive_support, negative_support"
ORACLES["binary_metrics"] = compared().sql(f"SELECT model, test_set, {_COUNTS}, {_RATES}, metric_note FROM comparison")


def add_quality(chain: Chain) -> Chain:
    return chain.add(
        "points",
        """SELECT model, true_label AS label, score FROM preds UNION ALL
        SELECT lang, quality, (least(n_chars, 5000) / 5000.0::DOUBLE)::DOUBLE FROM labels JOIN documents USING (doc_id)""",
    )


def add_ranking(chain: Chain, source: str, group: str) -> Chain:
    chain.add(
        "score_cells",
        f"""SELECT {group}, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
        FROM {source} GROUP BY ALL""",
    )
    chain.add(
        "curve",
        f"""SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM score_cells
        WINDOW w AS (PARTITION BY {group} ORDER BY score DESC)""",
    )
    return chain.add(
        "ranking",
        f"""SELECT {group}, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN
          sum(n::DOUBLE * (tp - p)::DOUBLE + n::DOUBLE * p::DOUBLE * 0.5::DOUBLE) / sum(p)::DOUBLE / sum(n)::DOUBLE END AS roc_auc,
        CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN
          sum(p::DOUBLE * (tp::DOUBLE / (tp + fp)::DOUBLE)) / sum(p)::DOUBLE END AS pr_auc
        FROM curve GROUP BY {group}""",
    )


ORACLES["roc_auc"] = add_ranking(add_quality(predicted()), "points", "model").sql(
    "SELECT model, round(roc_auc, 9) AS roc_auc FROM ranking"
)
ORACLES["avg_precision"] = add_ranking(add_quality(predicted()), "points", "model").sql(
    "SELECT model, round(pr_auc, 9) AS pr_auc FROM ranking"
)
_SWEEP = add_quality(predicted())
_SWEEP.add(
    "grid",
    "SELECT 0.05::DOUBLE + i * ((0.95::DOUBLE - 0.05::DOUBLE) / 180::DOUBLE) AS threshold FROM range(0, 181) r(i)",
)
_SWEEP.add(
    "swept",
    """SELECT model, threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp,
    count(*) FILTER (label = 0 AND score >= threshold) AS fp, count(*) FILTER (label = 1 AND score < threshold) AS fn
    FROM points, grid GROUP BY ALL""",
)
_SWEEP.add(
    "f1s",
    f"""SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1,
    CASE WHEN model = {lit(R.SIGNATURE)} THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS preferred FROM swept""",
)
_SWEEP.add("bests", "SELECT *, max(f1) OVER (PARTITION BY model) AS best FROM f1s")
ORACLES["calibrate"] = _SWEEP.sql(
    """SELECT model, preferred, threshold, round(top, 9) AS best_f1 FROM (
      SELECT *, max(f1) OVER (PARTITION BY model) AS top,
      row_number() OVER (PARTITION BY model ORDER BY abs(threshold - preferred), threshold) AS rn
      FROM bests WHERE abs(f1 - best) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(best)) WHERE rn = 1"""
)


def evaluated() -> Chain:
    chain = compared().add("eval_points", "SELECT model, test_set, true_label AS label, score FROM preds")
    add_ranking(chain, "eval_points", "model, test_set")
    models = values([(m,) for m in [*R.HEATMAP_MODELS, "Attention"]], ["model"], "m")
    chain.add("wanted", f"SELECT m.model, s.test_set FROM {models}, (SELECT DISTINCT test_set FROM preds) s")
    return chain.add(
        "evaluated",
        f"""SELECT model, test_set, {_RATES}, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc,
        NULL::DOUBLE AS latency_ms, NULL::DOUBLE AS throughput_lps, {_COUNTS}, threshold,
        coalesce(metric_note, {lit(E.UNAVAILABLE_NOTE)}) AS metric_note
        FROM wanted LEFT JOIN comparison USING (model, test_set) LEFT JOIN ranking USING (model, test_set)""",
    )


ORACLES["evaluate"] = evaluated().sql(f"SELECT {', '.join(E.COMPARISON_COLUMNS)} FROM evaluated")
ORACLES["evaluation_warnings"] = predicted().sql(
    """SELECT 'Attention unavailable for ' || test_set || '; metrics left as NaN.' AS warning
    FROM (SELECT DISTINCT test_set FROM preds)"""
)
ORACLES["error_analysis"] = errors().sql(
    f"""SELECT {', '.join(c for c in E.ERROR_COLUMNS if c != 'explanation')},
    {lit(E.ERROR_EXPLANATION)} AS explanation FROM errors"""
)
ORACLES["error_counts"] = errors().sql(
    "SELECT model, test_set, error_type, count(*) AS errors FROM errors GROUP BY ALL"
)
ORACLES["first_errors"] = errors().sql(
    "SELECT model, test_set, id, error_type, score FROM errors ORDER BY model, test_set, id LIMIT 200"
)
_CELLS = ", ".join(
    f"max({metric}) FILTER (test_set = '{split}') AS {name}"
    for split, metric, name in [
        ("test", "f1", "test_f1"),
        ("unseen_obfuscation_test", "f1", "unseen_f1"),
        ("adversarial_evasion_test", "f1", "adversarial_evasion_f1"),
        ("ood_stress_test", "f1", "ood_stress_f1"),
        ("ood_stress_test", "recall", "ood_stress_recall"),
        ("ood_stress_test", "fpr", "ood_stress_fpr"),
        ("blind_manual_test", "f1", "blind_manual_f1"),
        ("hard_negative_test", "fpr", "hard_negative_fpr"),
        ("test", "threshold", "threshold"),
    ]
)
ORACLES["ablation"] = errors().sql(
    f"""SELECT x.*, c.* EXCLUDE (model), coalesce(e.n, 0) AS model_error_count,
    {lit(R.EXPECTED_RESULT)} AS expected_result
    FROM {values(R.EXPERIMENTS, ['experiment', 'purpose', 'model'], 'x')}
    LEFT JOIN (SELECT model, {_CELLS} FROM comparison GROUP BY model) c ON c.model = x.model
    LEFT JOIN (SELECT model, count(*) AS n FROM errors GROUP BY model) e ON e.model = x.model"""
)


def recall_sql(test_set: str, models: list[str]) -> str:
    listed = ", ".join(lit(m) for m in models)
    return f"""SELECT obfuscation_type, model, support, misses, misses || '/' || support AS missed,
    (support - misses)::DOUBLE / support::DOUBLE AS recall FROM (
      SELECT obfuscation_type, model, count(*) AS support, count(*) FILTER (pred_label = 0) AS misses FROM preds
      WHERE test_set = '{test_set}' AND true_label = 1 AND model IN ({listed}) GROUP BY ALL)"""


ORACLES["family_recall"] = predicted().sql(recall_sql("adversarial_evasion_test", R.CHALLENGE_MODELS))
ORACLES["family_recall_joined"] = ORACLES["family_recall"]
ORACLES["missed_families"] = predicted().sql(
    f"""SELECT model, string_agg(obfuscation_type, ', ' ORDER BY obfuscation_type) AS missed_families,
    sum(misses)::BIGINT AS missed_rows FROM ({recall_sql('unseen_obfuscation_test', R.HEATMAP_MODELS)})
    WHERE misses > 0 GROUP BY model"""
)
ORACLES["family_rates"] = predicted().sql(
    """SELECT true_label, obfuscation_type, model, count(*) AS support, round(avg(pred_label), 9) AS rate
    FROM preds GROUP BY ALL"""
)
ORACLES["metric_lookup"] = compared().sql(
    f"""SELECT model, test_set, 'f1' AS metric, f1 AS value FROM comparison
    WHERE model = {lit(R.RAW)} AND test_set = 'ood_stress_test'"""
)
ORACLES["overview"] = predicted().sql(
    f"""SELECT count(*) AS dataset_rows,
    count(*) FILTER (split NOT IN ({', '.join(lit(s) for s in TRAINING_SPLITS)})) AS evaluation_rows,
    (SELECT count(DISTINCT model) FROM preds) AS model_variants,
    (SELECT count(DISTINCT test_set) FROM preds) AS test_splits FROM request_logs"""
)
ORACLES["model_ranking"] = compared().sql("SELECT model, f1 FROM comparison WHERE test_set = 'test'")
_PLACE = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(R.HEATMAP_SPLITS))
ORACLES["split_order"] = predicted().sql(
    f"""SELECT test_set, (CASE test_set {_PLACE} ELSE {len(R.HEATMAP_SPLITS)} END)::INT AS place
    FROM (SELECT DISTINCT test_set FROM preds)"""
)
ORACLES["other_splits"] = predicted().sql(
    f"""SELECT DISTINCT test_set FROM preds
    WHERE test_set NOT IN ({', '.join(lit(s) for s in R.HEATMAP_SPLITS)})"""
)
_HEAT = ", ".join(
    f"coalesce(max(f1) FILTER (model = {lit(m)}), 0) AS {m.lower().replace(' ', '_')}" for m in R.HEATMAP_MODELS
)
ORACLES["f1_heatmap"] = compared().sql(
    f"""SELECT test_set, (CASE test_set {_PLACE} END)::INT AS place, {_HEAT} FROM comparison
    WHERE test_set IN ({', '.join(lit(s) for s in R.HEATMAP_SPLITS)}) GROUP BY test_set"""
)
_THREE = ", ".join(lit(m) for m in (R.SIGNATURE, R.RAW, R.NORMALIZED))
_TWO = ", ".join(lit(m) for m in R.CHALLENGE_MODELS)
ORACLES["evasion_pivot"] = compared().sql(
    f"""SELECT model, max(recall) FILTER (test_set = 'test') AS standard_test,
    max(recall) FILTER (test_set = 'adversarial_evasion_test') AS adversarial_evasion
    FROM comparison WHERE model IN ({_THREE}) GROUP BY model"""
)
ORACLES["evasion_duel"] = compared().sql(
    f"""SELECT model, f1, fn || '/' || (tp + fn) AS missed FROM comparison
    WHERE test_set = 'adversarial_evasion_test' AND model IN ({_TWO})"""
)
ORACLES["ood_view"] = compared().sql(
    f"""SELECT model, recall AS malicious_recall, fpr AS benign_fpr FROM comparison
    WHERE test_set = 'ood_stress_test' AND model IN ({_THREE})"""
)
_SPLIT_ROWS = [(i, k, v) for i, (k, v) in enumerate(R.CHALLENGE_SPLITS.items())]
_MODEL_ROWS = list(enumerate(R.CHALLENGE_MODELS))
ORACLES["challenge_summary"] = compared().sql(
    f"""SELECT split_name, c.model, split_place::INT AS split_place, model_place::INT AS model_place,
    f1, recall, precision, fpr, tp, tn, fp, fn FROM comparison c
    JOIN {values(_SPLIT_ROWS, ['split_place', 'test_set', 'split_name'], 's')} ON s.test_set = c.test_set
    JOIN {values(_MODEL_ROWS, ['model_place', 'model'], 'm')} ON m.model = c.model"""
)

# -- features -----------------------------------------------------------------------------------------------------

ORACLES["class_weights"] = logs().sql(
    """SELECT label, count(*) AS rows, (sum(count(*)) OVER ())::DOUBLE / (2 * count(*))::DOUBLE AS class_weight
    FROM request_logs GROUP BY label"""
)
_VOCAB = canon().add(
    "chars",
    """SELECT DISTINCT unnest(string_split(t, '')) AS ch FROM (SELECT raw_log AS t FROM canon UNION ALL
    SELECT normalized_log FROM canon UNION ALL SELECT text FROM documents)""",
)
ORACLES["char_vocab"] = _VOCAB.sql(
    "SELECT ch, (row_number() OVER (ORDER BY ch) + 1)::INT AS id FROM chars WHERE ch <> ''"
)
_ENCODE = logs().add(
    "vocab",
    """SELECT ch, row_number() OVER (ORDER BY ch) + 1 AS id FROM (
      SELECT DISTINCT unnest(string_split(raw_log, '')) AS ch FROM request_logs WHERE split = 'train') WHERE ch <> ''""",
)
_ENCODE.add(
    "positions",
    """SELECT log_id, unnest(string_split(raw_log, '')) AS ch, unnest(generate_series(1, length(raw_log))) AS pos
    FROM request_logs""",
)
_ENCODE.add(
    "encoded",
    """SELECT log_id, string_agg(coalesce(id, 1)::VARCHAR, ',' ORDER BY pos) AS ids, count(*) AS n
    FROM positions LEFT JOIN vocab USING (ch) GROUP BY log_id""",
)
ORACLES["encode_chars"] = _ENCODE.sql("SELECT log_id, ids FROM encoded")

# -- learned detectors ---------------------------------------------------------------------------------------
# Rows by split and label, and that a model does well on each of them, which SQL can only expect.
for _variant in ("raw", "normalized", "signal"):
    ORACLES[f"learned_{_variant}"] = logs().sql(
        "SELECT split, label, count(*) AS rows, true AS learned FROM request_logs GROUP BY split, label"
    )

# -- streams that follow ---------------------------------------------------------------------------------------
ORACLES["stream_follow"] = ORACLES["scan_lines"]
ORACLES["stream_ledger"] = detected().sql(
    f"SELECT label, risk_level, score, count(*) AS rows FROM detected WHERE {_ALERT} GROUP BY ALL"
)
_TOTALS = detected()
_TOTALS.add("alerted", f"SELECT log_id, 1700000000 + log_id % 6000 AS sec, risk_level FROM detected WHERE {_ALERT}")
ORACLES["stream_totals"] = _TOTALS.sql(
    """SELECT 'total' AS part, NULL::BIGINT AS place, risk_level, count(*) AS rows FROM alerted GROUP BY ALL
    UNION ALL SELECT 'window', sec - sec % 600, risk_level, count(*) FROM alerted GROUP BY ALL
    UNION ALL (SELECT 'last', log_id, risk_level, 1 FROM alerted ORDER BY sec DESC, log_id DESC LIMIT 50)"""
)

# -- character language models -----------------------------------------------------------------------------------


def _lm_variant(chain: Chain, variant: str, column: str) -> Chain:
    """Counts, probabilities and weights of one variant, restated, and the sum of weights of every line."""
    v = f"lm_{variant}"
    chain.add(
        f"{v}_grams",
        f"""SELECT log_id, split, label, substring(chr(2) || chr(2) || t || chr(3), i, 3) AS gram
        FROM (SELECT log_id, split, label, coalesce({column}, '') AS t,
                     unnest(generate_series(1, length(coalesce({column}, '')) + 1)) AS i FROM canon)""",
    )
    chain.add(
        f"{v}_3",
        f"""SELECT gram, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1
        FROM {v}_grams WHERE split = 'train' GROUP BY gram""",
    )
    lower = None
    for n in (1, 2, 3):
        chain.add(
            f"{v}_s{n}",
            f"SELECT substring(gram, {4 - n}, {n}) AS gram, sum(n0)::BIGINT AS n0, sum(n1)::BIGINT AS n1 FROM {v}_3 GROUP BY 1",
        )
        below = "(1.0::DOUBLE / 256.0::DOUBLE)"
        join = "" if lower is None else f"JOIN {lower} b ON substring(s.gram, 2, {n - 1}) = b.gram"
        rates = ", ".join(
            f"(s.n{k}::DOUBLE + {below if lower is None else f'b.p{k}'} * 2) / (t{k} + 2)::DOUBLE AS p{k}" for k in (0, 1)
        )
        chain.add(
            f"{v}_p{n}",
            f"""SELECT s.gram, {rates} FROM {v}_s{n} s
            JOIN (SELECT substring(gram, 1, {n - 1}) AS h, sum(n0)::BIGINT AS t0, sum(n1)::BIGINT AS t1
                  FROM {v}_s{n} GROUP BY 1) t ON substring(s.gram, 1, {n - 1}) = t.h {join}""",
        )
        lower = f"{v}_p{n}"
        chain.add(f"{v}_w{n}", f"SELECT gram, CAST(round((ln(p1) - ln(p0)) * 1000000) AS BIGINT) AS w FROM {v}_p{n}")
    chain.add(
        f"{v}_text",
        f"""SELECT log_id, split, label, sum(coalesce(a.w, b.w, c.w, 0))::BIGINT AS total, count(*) AS n
        FROM {v}_grams g LEFT JOIN {v}_w3 a ON g.gram = a.gram LEFT JOIN {v}_w2 b ON right(g.gram, 2) = b.gram
        LEFT JOIN {v}_w1 c ON right(g.gram, 1) = c.gram GROUP BY ALL""",
    )
    if variant != "signal":
        return chain.add(v, f"SELECT '{variant}' AS model, * FROM {v}_text")
    weight = lambda top, under: f"CAST(round((ln({top}) - ln({under})) * 1000000) AS BIGINT)"
    sums = ", ".join(
        f"count(*) FILTER (label = 1 AND {k}) AS {k}_1, count(*) FILTER (label = 0 AND {k}) AS {k}_0" for k in SIGNAL_KEYS
    )
    shares = ", ".join(
        f"""{weight(f"({k}_1 + 1)::DOUBLE / (t1 + 2)::DOUBLE", f"({k}_0 + 1)::DOUBLE / (t0 + 2)::DOUBLE")} AS {k}_set,
        {weight(f"(t1 - {k}_1 + 1)::DOUBLE / (t1 + 2)::DOUBLE", f"(t0 - {k}_0 + 1)::DOUBLE / (t0 + 2)::DOUBLE")} AS {k}_not"""
        for k in SIGNAL_KEYS
    )
    chain.add(
        f"{v}_sums",
        f"""SELECT count(*) FILTER (label = 1) AS t1, count(*) FILTER (label = 0) AS t0, {sums}
        FROM canon WHERE split = 'train'""",
    )
    chain.add(f"{v}_shares", f"SELECT {shares} FROM {v}_sums")
    told = " + ".join(f"CASE WHEN {k} THEN {k}_set ELSE {k}_not END" for k in SIGNAL_KEYS)
    chain.add(f"{v}_signals", f"SELECT log_id, {told} AS extra FROM canon, {v}_shares")
    return chain.add(
        v,
        f"""SELECT 'signal' AS model, log_id, split, label, total + extra AS total, n + {len(SIGNAL_KEYS)} AS n
        FROM {v}_text JOIN {v}_signals USING (log_id)""",
    )


def charlm() -> Chain:
    chain = canon()
    for variant, column in (("raw", "raw_log"), ("normalized", "normalized_log"), ("signal", "normalized_log")):
        _lm_variant(chain, variant, column)
    return chain.add("lm", " UNION ALL ".join(f"SELECT * FROM lm_{v}" for v in ("raw", "normalized", "signal")))


ORACLES["charlm_scores"] = charlm().sql("SELECT log_id, model, total, n FROM lm")
ORACLES["charlm_splits"] = charlm().sql(
    """SELECT model, split, label, count(*) AS rows, count(*) FILTER ((total >= 0) = (label = 1)) AS "right"
    FROM lm GROUP BY ALL"""
)
_AREAS = charlm()
_AREAS.add("lm_held", "SELECT model, split, label, total / n AS score FROM lm WHERE split NOT IN ('train', 'val')")
_AREAS.add("lm_points", "SELECT * FROM lm_held UNION ALL SELECT model, 'held out', label, score FROM lm_held")
ORACLES["charlm_auc"] = add_ranking(_AREAS, "lm_points", "model, split").sql(
    "SELECT model, split, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc FROM ranking"
)
_LM_REPORT = charlm()
_LM_REPORT.add(
    "preds",
    f"""SELECT CASE model {' '.join(f"WHEN '{k}' THEN {lit(DISPLAY_NAMES[k])}" for k in ("raw", "normalized", "signal"))} END
    AS model, split AS test_set, 0.5::DOUBLE AS threshold, label AS true_label, (total >= 0)::INT AS pred_label FROM lm""",
)
ORACLES["charlm_evaluate"] = add_comparison(_LM_REPORT).sql(
    f"SELECT {', '.join(c for c in E.COMPARISON_COLUMNS if c not in ('roc_auc', 'pr_auc', 'latency_ms', 'throughput_lps'))} FROM comparison"
)

# -- training by epochs ------------------------------------------------------------------------------------------
ORACLES["training_splits"] = logs().sql(
    """SELECT model, split, label, count(*) AS rows, true AS learned
    FROM request_logs, (VALUES ('raw'), ('normalized'), ('signal')) m(model) GROUP BY ALL"""
)
ORACLES["training_history"] = """SELECT model, true AS several_epochs, true AS train_loss_falls, true AS least_is_chosen,
    1::BIGINT AS chosen, true AS same_after_reading FROM (VALUES ('raw'), ('normalized'), ('signal')) m(model)"""

# -- labelled CSV ----------------------------------------------------------------------------------------------
ORACLES["labelled_csv"] = """SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN CAST(doc_id % 2 AS INTEGER) END AS label,
    CASE WHEN doc_id % 10 > 0 THEN md5(coalesce(text, '')) END AS digest,
    CASE doc_id % 20 WHEN 0 THEN 'cells' WHEN 10 THEN 'label' ELSE '' END AS reason FROM documents"""

# -- one split replaced ----------------------------------------------------------------------------------------
_REWRITE = logs()
_REWRITE.add(
    "now",
    """SELECT split, label, 'source ' || (log_id % 3) AS source, family AS obfuscation_type FROM request_logs
    WHERE split <> 'ood_stress_test'
    UNION ALL SELECT split, label, 'again', family || ' again' FROM request_logs WHERE split = 'ood_stress_test' AND label = 1""",
)
ORACLES["split_rewrite"] = _REWRITE.sql(
    """SELECT 'by_split' AS statistic, split AS value, count(*) AS rows FROM now GROUP BY ALL
    UNION ALL SELECT 'by_label', label::VARCHAR, count(*) FROM now GROUP BY ALL
    UNION ALL SELECT 'by_source', source, count(*) FROM now GROUP BY ALL
    UNION ALL SELECT 'by_obfuscation_type', obfuscation_type, count(*) FROM now GROUP BY ALL
    UNION ALL SELECT 'total_rows', '', count(*) FROM now
    UNION ALL SELECT 'files kept', split, count(*) FROM now WHERE split <> 'ood_stress_test' GROUP BY ALL"""
)
ORACLES["taxonomy_merge"] = logs().sql(
    """SELECT coalesce(o.obfuscation_type, n.obfuscation_type) AS obfuscation_type,
    coalesce(n.description, o.description) AS description
    FROM (SELECT family AS obfuscation_type, 'before: ' || count(*) || ' lines' AS description FROM request_logs
          WHERE split <> 'test' GROUP BY ALL) o
    FULL JOIN (SELECT family AS obfuscation_type, 'now: ' || count(*) || ' lines' AS description FROM request_logs
          WHERE split IN ('train', 'test') GROUP BY ALL) n ON o.obfuscation_type = n.obfuscation_type"""
)

# -- measured times ----------------------------------------------------------------------------------------------
_TIMED = charlm()
add_signature(_TIMED, "canon", "signed")
ORACLES["evaluate_timed"] = _TIMED.sql(
    f"""SELECT model, split AS test_set, count(*) FILTER (label = 1 AND hit) AS tp, count(*) FILTER (label = 0 AND hit) AS fp,
    true AS timed, true AS fits
    FROM (SELECT {lit(R.SIGNATURE)} AS model, split, label, sig_score >= 0.7 AS hit FROM signed
          UNION ALL SELECT {lit(R.RAW)}, split, label, total >= 0 FROM lm_raw) GROUP BY ALL"""
)
