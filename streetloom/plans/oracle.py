"""SQL for the core queries, for another engine over the same tables.

It is written from the meaning of the operators, set-wise: tokens and claims are rows, spans are self-joins, ordered
rules are a joined table of patterns.
"""

from __future__ import annotations

from streetloom.functions import text as tx
from streetloom.vocab import tables as v

_W = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_FIELDS = ["business_name", "primary_number", "predirectional", "street_name", "street_suffix", "postdirectional", "secondary_designator", "secondary_number", "city", "region", "postal", "country"]


def _q(x) -> str:
    return ("TRUE" if x else "FALSE") if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"


def _table(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ",".join("(" + ",".join(_q(x) for x in r) + ")" for r in rows) + ")"


REGION = _table("vr", "k,primary_name,short,street", [(k, *r) for k, r in v.regions().items()])
SUFFIX = _table("vs", "k,primary_name,short", [(k, *s) for k, s in v.suffixes().items()])
UNIT = _table("vu", "k,short,numbered", [(k, *u) for k, u in v.units().items()])
DIRECTION = _table("vd", "k,short,full_name", [(k, s, d) for d, s in v.DIRECTIONS.items() for k in (d, s)])


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_W}', ' ', 'g'))"


def _unknown(x: str) -> str:
    return f"CASE WHEN upper({x}) = 'UNKNOWN' THEN '' ELSE {x} END"


def _base(x: str) -> str:
    return f"upper({_unknown(_collapse(x))})"


def _strip(x: str, hyphen: bool = False, slash: bool = False) -> str:
    gone = "[*,.()\":;`@&''’" + ("" if hyphen else "\\-") + ("" if slash else "/") + "]"
    return f"regexp_replace({x}, '{gone}', '', 'g')"


def _key(x: str) -> str:
    return f"upper(regexp_replace({x}, '[^a-zA-Z0-9 ]+', '', 'g'))"


def _substitute(x: str) -> str:
    """Only Latin text loses its accents here: other scripts are left out, as the standard's table is."""
    y = f"replace(replace(replace({x}, 'Œ', 'o'), 'œ', 'o'), 'ß', 's')"
    y = f"translate({y}, 'ÆæÐðØø×÷Þþ', 'aaeeoooopp')"
    latin = f"list_aggregate(list_transform(string_split({y}, ''), lambda c: CASE WHEN (ord(c) BETWEEN 192 AND 591) OR (ord(c) BETWEEN 7680 AND 7935) OR (ord(c) BETWEEN 880 AND 1327) OR (ord(c) BETWEEN 7936 AND 8191) THEN strip_accents(c) ELSE c END), 'string_agg', '')"
    return f"lower(regexp_replace(CASE WHEN {x} = '' THEN '' ELSE {latin} END, '\\p{{Mn}}+', '', 'g'))"


def _transliterate(x: str) -> str:
    """Letters by table, then marks off the Latin, Greek and Cyrillic ones, then the table again for what is left."""
    def spelled(y: str) -> str:
        for k, to in tx._SPELLED.items():
            y = f"replace({y}, {_q(k)}, {_q(to)})"
        return y

    bare = f"list_aggregate(list_transform(string_split({spelled(x)}, ''), lambda c: CASE WHEN (ord(c) BETWEEN 192 AND 591) OR (ord(c) BETWEEN 7680 AND 8191) OR (ord(c) BETWEEN 880 AND 1327) THEN strip_accents(c) ELSE c END), 'string_agg', '')"
    return f"lower(regexp_replace(CASE WHEN {x} = '' THEN '' ELSE {spelled(bare)} END, '\\p{{Mn}}+', '', 'g'))"


def _zip_case(compact: str, other: str) -> str:
    ca = f"replace({compact}, '-', '')"
    return (f"CASE WHEN regexp_matches({compact}, '^[0-9]{{5}}$') THEN {compact} WHEN regexp_matches({compact}, '^[0-9]{{5}}-?[0-9]{{4}}$') THEN left({compact}, 5) || '-' || right({compact}, 4) "
            f"WHEN regexp_matches({ca}, '^[A-Z][0-9][A-Z][0-9][A-Z][0-9]$') THEN left({ca}, 3) || ' ' || right({ca}, 3) ELSE {other} END")


def _postal(x: str) -> str:
    compact = f"replace({_collapse(_strip(_base(x), hyphen=True))}, ' ', '')"
    return _zip_case(compact, _collapse(_strip(_base(x))))


def _classify(x: str) -> str:
    compact = f"replace({_collapse(_strip('upper(' + _unknown(x) + ')', hyphen=True))}, ' ', '')"
    return _zip_case(compact, "NULL")


def _country(x: str) -> str:
    n = f"upper(regexp_replace(regexp_replace(regexp_replace({x}, '[+&]', ' AND ', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g'), '[^a-zA-Z0-9 ]+', '', 'g'))"
    return f"CASE {n} " + " ".join(f"WHEN {_q(k)} THEN {_q(c)}" for k, c in v.COUNTRIES.items()) + f" ELSE {n} END"


def _pobox(x: str) -> str:
    t = f"regexp_replace(regexp_replace(upper({x}), '[ \\t\\n\\f\\r]*#[ \\t\\n\\f\\r]*', ' ', 'g'), '{'|'.join(v.BOX_DESIGNATORS)}', 'PO BOX', 'g')"
    return f"CASE WHEN regexp_full_match({t}, 'PO BOX [0-9A-Z]+') THEN {t} END"


def _rural(x: str) -> str:
    s = "[ \\t\\n\\f\\r]"
    t = f"regexp_replace(upper({x}), 'R(D|R|FD|FD ROUTE|URAL ROUTE){s}*(#|NUMBER|NUM|NO){s}*', 'R\\1 ', 'g')"
    t = f"regexp_replace({t}, '([0-9A-Z]+){s}*(BOX{s}+)?(#|NUMBER|NUM|NO){s}*', '\\1 BOX ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '[^0-9A-Z ]+', '', 'g'), ' +', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '{'|'.join(v.RURAL_DESIGNATORS)}', 'RR', 'g'), '(RR|BOX) *0+', '\\1 ', 'g')"
    return f"nullif(regexp_extract({t}, '^RR [1-9A-Z][0-9A-Z]* BOX [0-9A-Z]+'), '')"


def _military(x: str) -> str:
    t = _collapse(f"upper({x})")
    return f"CASE WHEN regexp_full_match({t}, '({'|'.join(v.MILITARY_STREETS)}) [0-9]+ BOX [0-9]+') THEN {t} END"


_LAST = f"^({'|'.join(v.MILITARY_CITIES)}) ({'|'.join(v.MILITARY_REGIONS)}) ([0-9]{{5}}(-[0-9]{{4}})?)$"

# --- highways: the rules as a table of patterns ---

_H, _R, _T, _D = "(HWY|HIGHWAY)", "(RD|ROAD)", "(RT|RTE|ROUTE)", "[0-9]+(\\.[0-9]+)?[A-Z]*"
_RULES = [
    ("FARM TO MARKET", "any", "FM"), (f"{_H} FM", "any", "FM"), ("FM", "any", "FM"), (f"INTERSTATE( {_H})?", "digit", "INTERSTATE"), ("(I|IH)", "digit", "INTERSTATE"), (f"US( {_H})?", "digit", "US HIGHWAY"),
    ("CR", "any", "COUNTY ROAD"), (f"(COUNTY|CNTY) {_H}", "any", "COUNTY HIGHWAY"), (f"(COUNTY|CNTY) {_R}", "any", "COUNTY ROAD"), ("TSR", "any", "TOWNSHIP ROAD"), (f"TOWNSHIP {_R}", "any", "TOWNSHIP ROAD"), (f"RANCH {_R}", "any", "RANCH ROAD"),
    (f"(STATE|ST) {_H}", "any", "STATE HIGHWAY"), (f"(STATE|ST) {_R}", "any", "STATE ROAD"), (f"(STATE|ST) {_T}", "any", "STATE ROUTE"), ("SR", "digit", "STATE ROAD"), ("SR", "any", "STATE ROUTE"),
    (_H, "digit", "HIGHWAY"), (_R, "digit", "ROAD"), (_T, "digit", "ROUTE"), ("EXPRESSWAY", "digit", "EXPRESSWAY"),
]
_RESERVED = "HWY HIGHWAY RD ROAD RT RTE ROUTE BYP BYPASS FRONTAGE COUNTY CNTY STATE ST TOWNSHIP RANCH US FM INTERSTATE EXPRESSWAY SR CR TSR IH I".split()


def _highway_ctes(source: str) -> str:
    """CTEs that end in hw(text, highway) for the distinct texts of a query `source` with the column text."""
    states = v.state_prefixes()
    rules = _table("rules", "ord,opening,kind,becomes", [(i, o, k, b) for i, (o, k, b) in enumerate(_RULES)]).replace("'" + "0" + "'", "0")
    reserved = ",".join(_q(x) for x in _RESERVED)
    names = _table("sp", "name,code", list(states.items()))
    tail = "rest"
    by = "(BYP|BYPASS|BYPA|BYPAS|BYPS)"
    # every blank doubled, so that words next to each other can both be replaced
    tail = f"regexp_replace(' ' || replace({tail}, ' ', '  ') || ' ', ' {by}  {_R} ', ' ~  RD ', 'g')"
    tail = f"regexp_replace(regexp_replace({tail}, ' {by} ', ' BYP ', 'g'), ' {_R} ', ' RD ', 'g')"
    tail = f"trim(replace(replace({tail}, '~', 'BYPASS'), '  ', ' '))"
    return f"""{rules}, {names},
hw0 AS (SELECT DISTINCT text FROM ({source})),
hw1 AS (SELECT text, trim(regexp_replace(' ' || replace({_collapse('upper(text)')}, ' ', '  ') || ' ', ' (IH?)([0-9]+[A-Z]*) ', ' \\1 \\2 ', 'g')) AS t FROM hw0),
hw2 AS (SELECT text, regexp_replace(t, ' +', ' ', 'g') AS s FROM hw1),
hw3 AS (SELECT text, s, (SELECT code FROM sp WHERE starts_with(s, name || ' ') ORDER BY length(name) - length(replace(name, ' ', '')) DESC, length(name) DESC LIMIT 1) AS code,
  (SELECT name FROM sp WHERE starts_with(s, name || ' ') ORDER BY length(name) - length(replace(name, ' ', '')) DESC, length(name) DESC LIMIT 1) AS name,
  EXISTS (SELECT 1 FROM sp WHERE name = s AND contains(name, ' ')) AS alone FROM hw2),
hw4 AS (SELECT text, 1 AS which, code, substr(s, length(name) + 2) AS s FROM hw3 WHERE code IS NOT NULL AND NOT alone UNION ALL SELECT text, 2, NULL, s FROM hw3),
hw5 AS (SELECT h.text, h.which, h.code, h.s, r.ord, r.kind, r.becomes, regexp_replace(h.s, '^' || r.opening || ' ', '') AS rest FROM hw4 h JOIN rules r ON regexp_matches(h.s, '^' || r.opening || ' ')),
hw6 AS (SELECT * FROM hw5 WHERE CASE WHEN kind = 'digit' THEN regexp_full_match(split_part(rest, ' ', 1), '{_D}') ELSE regexp_full_match(split_part(rest, ' ', 1), '({_D}|[A-Z]+)') AND split_part(rest, ' ', 1) NOT IN ({reserved}) END),
hw7 AS (SELECT text, which, code, arg_min(becomes || ' ' || {tail}, CAST(ord AS INTEGER)) AS core FROM hw6 GROUP BY text, which, code),
hw8 AS (SELECT text, 0 AS pref, code || ' ' || core AS highway FROM hw7 WHERE which = 1 UNION ALL
  SELECT text, 1, code || ' HIGHWAY ' || {tail.replace('rest', 's')} FROM hw4 WHERE which = 1 AND regexp_full_match(split_part(s, ' ', 1), '{_D}') UNION ALL
  SELECT text, 2, core FROM hw7 WHERE which = 2),
hw AS (SELECT text, arg_min(highway, pref) AS highway FROM hw8 GROUP BY text)"""


# --- tokens and spans as rows ---

_TOKENS = r"""rr AS (SELECT row_number() OVER () AS rid, addr_id, raw FROM raw_addresses),
ln AS (SELECT rid, addr_id, line, string_split(coalesce(raw, ''), chr(10))[line + 1] AS ltext, len(string_split(coalesce(raw, ''), chr(10))) AS of_lines FROM (SELECT *, unnest(range(len(string_split(coalesce(raw, ''), chr(10))))) AS line FROM rr)),
pc AS (SELECT rid, addr_id, line, of_lines, k, regexp_extract_all(ltext, '([^, \t\n\f\r]+|[, \t\n\f\r]+)')[k + 1] AS piece FROM (SELECT *, unnest(range(len(regexp_extract_all(ltext, '([^, \t\n\f\r]+|[, \t\n\f\r]+)')))) AS k FROM ln)),
pd AS (SELECT *, regexp_matches(piece, '^[, \t\n\f\r]') AS gap, length(piece) - length(replace(piece, ',', '')) AS commas FROM pc),
pe AS (SELECT *, sum(CASE WHEN gap THEN commas ELSE 0 END) OVER (PARTITION BY rid, line ORDER BY k) AS seen, lag(CASE WHEN gap THEN commas ELSE 0 END, 1, 0) OVER (PARTITION BY rid, line ORDER BY k) AS just FROM pd),
tok AS (SELECT rid, addr_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY line, k) - 1 AS INTEGER) AS idx, piece AS text, CAST(line AS INTEGER) AS line, CAST(of_lines AS INTEGER) AS of_lines,
  CAST(row_number() OVER (PARTITION BY rid, line ORDER BY k) - 1 AS INTEGER) AS position, CAST(CASE WHEN just > 0 THEN seen - 1 ELSE -1 END AS INTEGER) AS follows_comma FROM pe WHERE NOT gap),
cnt AS (SELECT rid, addr_id, CAST(count(*) AS INTEGER) AS n FROM tok GROUP BY rid, addr_id),
le AS (SELECT rid, line, max(idx) + 1 AS line_end, min(idx) AS line_start FROM tok GROUP BY rid, line),
sp8 AS (SELECT a.rid, a.addr_id, a.idx AS start_at, CAST(g.k AS INTEGER) AS length, string_agg(b.text, ' ' ORDER BY b.idx) AS text, any_value(le.line_end) AS line_end
  FROM tok a CROSS JOIN (SELECT unnest(range(1, 9)) AS k) g JOIN cnt ON cnt.rid = a.rid AND a.idx + g.k <= cnt.n JOIN tok b ON b.rid = a.rid AND b.idx >= a.idx AND b.idx < a.idx + g.k JOIN le ON le.rid = a.rid AND le.line = a.line
  GROUP BY a.rid, a.addr_id, a.idx, g.k)"""

_C = "rid, addr_id, confidence, part_no, start_at, length, part, value, claim"
#: Claims as rows (one for each part); claim tells the parts of one claim apart from those of another at its place.
_CLAIMS = {
    "region": f"""SELECT rid, addr_id, CASE WHEN length = 1 AND strlen(text) = 2 THEN 100 ELSE 90 END AS confidence, 0 AS part_no, start_at, length, 'region' AS part, short AS value, 'r' AS claim FROM sp8 JOIN vr ON {_key('text')} = vr.k
      UNION ALL SELECT rid, addr_id, 75, 0, start_at, length, 'street_name', primary_name, 'rs' FROM sp8 JOIN vr ON {_key('text')} = vr.k WHERE street""",
    "postal": f"""SELECT rid, addr_id, CASE WHEN length(value) = 5 THEN 50 ELSE 90 END AS confidence, 0 AS part_no, start_at, length, 'postal' AS part, value, 'p' AS claim FROM (SELECT *, {_classify('text')} AS value FROM sp8 WHERE length <= 2) WHERE value IS NOT NULL""",
    "country": f"""SELECT rid, addr_id, CASE WHEN length = 1 AND strlen(text) <= 3 THEN 100 ELSE 90 END AS confidence, 0 AS part_no, start_at, length, 'country' AS part, CASE text {' '.join(f'WHEN {_q(k)} THEN {_q(c)}' for k, c in v.COUNTRIES.items())} END AS value, 'c' AS claim FROM sp8 WHERE length <= 2 AND text IN ({','.join(_q(k) for k in v.COUNTRIES)})""",
    "directional": """SELECT rid, addr_id, confidence, 0 AS part_no, start_at, length, part, value, 'd' || part AS claim FROM (
      SELECT t.rid, t.addr_id, CASE WHEN upper(t.text) = d.full_name THEN 90 ELSE 100 END AS confidence, t.idx AS start_at, 1 AS length, d.short AS value FROM tok t JOIN vd d ON d.k = upper(t.text)
      UNION ALL SELECT t.rid, t.addr_id, CASE WHEN upper(t.text) = d.full_name OR upper(u.text) = e.full_name THEN 75 ELSE 90 END, t.idx, 2, d.short || e.short FROM tok t JOIN vd d ON d.k = upper(t.text) JOIN tok u ON u.rid = t.rid AND u.idx = t.idx + 1 JOIN vd e ON e.k = upper(u.text)
        WHERE d.short || e.short IN (SELECT short FROM vd)) x CROSS JOIN (VALUES ('predirectional'), ('postdirectional')) p(part)""",
    "secondary": r"""SELECT rid, addr_id, confidence, p.part_no, CAST(start_at + p.part_no AS INTEGER) AS start_at, 1 AS length, CASE WHEN p.part_no = 0 THEN 'secondary_designator' ELSE 'secondary_number' END AS part, CASE WHEN p.part_no = 0 THEN short ELSE upper(nx) END AS value, 'u' AS claim FROM (
      SELECT t.rid, t.addr_id, t.idx AS start_at, u.short, u.numbered, n.text AS nx, CASE WHEN u.numbered AND NOT regexp_matches(n.text, '\p{Nd}') AND NOT regexp_full_match(n.text, '\p{L}') THEN 75 WHEN upper(t.text) = u.short THEN 100 ELSE 90 END AS confidence
      FROM tok t JOIN vu u ON u.k = upper(t.text) LEFT JOIN tok n ON n.rid = t.rid AND n.idx = t.idx + 1 WHERE NOT u.numbered OR n.text IS NOT NULL) x JOIN (VALUES (0), (1)) p(part_no) ON p.part_no = 0 OR numbered""",
    "suffix": f"""SELECT rid, addr_id, CASE WHEN {_key('text')} = short THEN 100 ELSE 90 END AS confidence, 0 AS part_no, idx AS start_at, 1 AS length, 'street_suffix' AS part, short AS value, 's' AS claim FROM tok JOIN vs ON {_key('text')} = vs.k""",
    "highway": """SELECT rid, addr_id, 90 AS confidence, 0 AS part_no, start_at, length, 'street_name' AS part, highway AS value, 'h' AS claim FROM sp8 JOIN hw ON hw.text = sp8.text""",
    "pobox": f"""SELECT rid, addr_id, CASE WHEN upper(left(text, length(text) - length(split_part(text, ' ', CAST(length AS INTEGER))) - 1)) IN ({','.join(_q(x) for x in v.BOX_RESERVED)}) THEN 100 ELSE 90 END AS confidence, p.part_no,
      CAST(CASE WHEN p.part_no = 0 THEN start_at ELSE start_at + length - 1 END AS INTEGER) AS start_at, CAST(CASE WHEN p.part_no = 0 THEN length - 1 ELSE 1 END AS INTEGER) AS length, CASE WHEN p.part_no = 0 THEN 'street_name' ELSE 'primary_number' END AS part,
      CASE WHEN p.part_no = 0 THEN 'PO BOX' ELSE split_part(box, ' ', 3) END AS value, 'b' AS claim FROM (SELECT *, row_number() OVER (PARTITION BY rid, start_at ORDER BY length) AS nth FROM (SELECT *, {_pobox('text')} AS box FROM sp8 WHERE length BETWEEN 2 AND 4 AND start_at + length <= line_end) WHERE box IS NOT NULL) CROSS JOIN (VALUES (0), (1)) p(part_no) WHERE nth = 1""",
    "rural_route": f"""SELECT rid, addr_id, CASE WHEN stop = start0 + len0 THEN 100 ELSE 75 END AS confidence, p.part_no, CAST(CASE WHEN p.part_no = 0 THEN start0 ELSE start0 + cut END AS INTEGER) AS start_at, CAST(CASE WHEN p.part_no = 0 THEN cut ELSE stop - start0 - cut END AS INTEGER) AS length,
      CASE WHEN p.part_no = 0 THEN 'street_name' ELSE 'primary_number' END AS part, CASE WHEN p.part_no = 0 THEN split_part(route, ' ', 1) || ' ' || split_part(route, ' ', 2) ELSE split_part(route, ' ', 3) || ' ' || split_part(route, ' ', 4) END AS value, 'rr' || stop AS claim FROM (
      SELECT f.*, unnest(CASE WHEN f.line_end > f.start0 + f.len0 THEN [f.start0 + f.len0, f.line_end] ELSE [f.start0 + f.len0] END) AS stop FROM (
        SELECT s.rid, s.addr_id, s.start_at AS start0, s.length AS len0, s.line_end, s.route, (SELECT min(t.idx) - s.start_at FROM tok t WHERE t.rid = s.rid AND t.idx > s.start_at AND t.idx < s.start_at + s.length AND regexp_matches(upper(t.text), '^(BOX|#|NUMBER|NUM|NO)')) AS cut
        FROM (SELECT *, row_number() OVER (PARTITION BY rid, start_at ORDER BY length) AS nth FROM (SELECT *, {_rural('text')} AS route FROM sp8 WHERE length <= 7 AND start_at + length <= line_end) WHERE route IS NOT NULL) s WHERE nth = 1) f WHERE cut IS NOT NULL) CROSS JOIN (VALUES (0), (1)) p(part_no)""",
    "military": f"""SELECT rid, addr_id, 100 AS confidence, 0 AS part_no, idx AS start_at, 1 AS length, CASE WHEN upper(text) IN ('APO','FPO','DPO') THEN 'city' ELSE 'region' END AS part, upper(text) AS value, 'm' AS claim FROM tok WHERE upper(text) IN ('APO','FPO','DPO','AE','AP','AA')
      UNION ALL SELECT rid, addr_id, 100, p.part_no, CAST(start_at + 2 * p.part_no AS INTEGER), 2, CASE WHEN p.part_no = 0 THEN 'street_name' ELSE 'primary_number' END, CASE WHEN p.part_no = 0 THEN split_part(mil, ' ', 1) || ' ' || split_part(mil, ' ', 2) ELSE split_part(mil, ' ', 3) || ' ' || split_part(mil, ' ', 4) END, 'ms' FROM (SELECT *, {_military('text')} AS mil FROM sp8 WHERE length = 4 AND start_at + 4 <= line_end) CROSS JOIN (VALUES (0), (1)) p(part_no) WHERE mil IS NOT NULL""",
}
_VOCAB = f"{REGION}, {SUFFIX}, {UNIT}, {DIRECTION}"


def _claims_sql(name: str) -> str:
    hw = _highway_ctes("SELECT text FROM sp8") + "," if name == "highway" else ""
    return f"WITH {_VOCAB}, {_TOKENS}, {hw} cl AS ({_CLAIMS[name]}) SELECT addr_id, CAST(confidence AS INTEGER) AS confidence, CAST(part_no AS INTEGER) AS part_no, CAST(start_at AS INTEGER) AS start_at, CAST(length AS INTEGER) AS length, part, value FROM cl"


_UNION = " UNION ALL ".join(f"SELECT *, {_q(n)} AS vocab FROM ({q})" for n, q in _CLAIMS.items() if n in ("region", "postal", "country", "pobox", "rural_route", "military"))
#: Claims with their extent and number, then the readings of the last line.
_LINES = f"""allp AS MATERIALIZED (SELECT row_number() OVER () AS pid, * FROM ({_UNION})),
cls AS MATERIALIZED (SELECT rid, addr_id, vocab, claim, min(start_at) - 0 AS c_start, max(start_at + length) AS c_end, any_value(confidence) AS confidence, count(*) AS n_parts, arg_min(part, part_no) AS part, arg_min(value, part_no) AS value, min(pid) AS cid
  FROM (SELECT *, CASE WHEN part_no = 0 THEN start_at ELSE max(CASE WHEN part_no = 0 THEN start_at END) OVER (PARTITION BY rid, vocab, claim ORDER BY start_at, part_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS head, CASE WHEN vocab IN ('region', 'postal', 'country') THEN length ELSE 0 END AS own FROM allp)
  GROUP BY rid, addr_id, vocab, claim, head, own),
ct AS (SELECT rid, addr_id, n AS inner_end, NULL AS ccid, NULL AS c_from, NULL AS cval, n FROM cnt UNION ALL SELECT c.rid, c.addr_id, c.c_start, c.cid, c.c_start, c.value, cnt.n FROM cls c JOIN cnt USING (rid) WHERE c.n_parts = 1 AND c.part = 'country' AND c.c_end = cnt.n AND c.c_start > 0),
ci AS (SELECT ct.*, le.line_start FROM ct JOIN tok t ON t.rid = ct.rid AND t.idx = ct.inner_end - 1 JOIN le ON le.rid = t.rid AND le.line = t.line),
po AS (SELECT ci.*, p.cid AS pcid, p.c_start AS p_from, p.value AS pval FROM ci JOIN cls p ON p.rid = ci.rid AND p.n_parts = 1 AND p.part = 'postal' AND p.c_end = ci.inner_end),
base AS (SELECT 'city_region_postal' AS shape, po.rid, po.addr_id, po.n, po.line_start, r.c_start AS city_end, ccid, cval, pcid, pval, r.cid AS rcid, r.value AS rval FROM po JOIN cls r ON r.rid = po.rid AND r.n_parts = 1 AND r.part = 'region' AND r.c_end = po.p_from
  UNION ALL SELECT 'city_postal', rid, addr_id, n, line_start, p_from, ccid, cval, pcid, pval, NULL, NULL FROM po
  UNION ALL SELECT 'city_region', ci.rid, ci.addr_id, ci.n, ci.line_start, r.c_start, ccid, cval, NULL, NULL, r.cid, r.value FROM ci JOIN cls r ON r.rid = ci.rid AND r.n_parts = 1 AND r.part = 'region' AND r.c_end = ci.inner_end),
cities AS (SELECT b.*, t.idx AS start_at, (SELECT upper(string_agg(u.text, ' ' ORDER BY u.idx)) FROM tok u WHERE u.rid = b.rid AND u.idx >= t.idx AND u.idx < b.city_end) AS city, t.follows_comma >= 0 OR (t.idx = b.line_start AND t.line > 0) AS marked
  FROM base b JOIN tok t ON t.rid = b.rid AND t.idx >= b.line_start AND t.idx < b.city_end WHERE t.idx = b.line_start OR t.follows_comma >= 0 OR b.city_end - t.idx <= 4),
lines0 AS (SELECT shape, rid, addr_id, n, start_at, CASE WHEN city = 'UNKNOWN' THEN '' ELSE city END AS city, coalesce(rval, '') AS region, coalesce(pval, '') AS postal, coalesce(cval, '') AS country, 0 AS gaps, ccid, pcid, rcid,
    CASE shape WHEN 'city_region_postal' THEN CASE WHEN marked THEN 100 ELSE 90 END WHEN 'city_region' THEN CASE WHEN marked THEN 90 ELSE 75 END ELSE CASE WHEN marked THEN 75 ELSE 50 END END AS rate FROM cities
  UNION ALL SELECT 'postal', rid, addr_id, n, least(line_start, p_from), '', '', pval, coalesce(cval, ''), CASE WHEN line_start < p_from THEN 1 ELSE 0 END, ccid, pcid, NULL, 90 FROM po),
lines AS (SELECT *, CASE WHEN gaps = 0 THEN rate ELSE 75 END AS confidence, n - start_at AS length FROM lines0)"""

_LINE_HEAD = f"WITH {_VOCAB}, {_TOKENS}, {_LINES}"


def _scalar(select: str, ctes: str = "", joins: str = "") -> str:
    return f"{'WITH ' + ctes if ctes else ''} SELECT a.addr_id, {select} FROM addresses a {joins}"


def _free(x: str, mode: str) -> str:
    return f"upper({_substitute(_base(x))})" if mode == "sub" else _base(x)


def _normal_ctes(mode: str, as_hash: bool) -> str:
    """CTEs that end in done(addr_id, type, fields..., error)."""
    f = {n: f"coalesce(a.{n}, '')" for n in _FIELDS}
    sn = _free(f["street_name"], mode)
    word = """CASE WHEN k < n AND street IS NOT NULL AND street THEN CASE WHEN k = 1 AND n <= 2 THEN rprimary ELSE rshort END WHEN k < n AND sprimary IS NOT NULL THEN sprimary WHEN dfull IS NOT NULL THEN dfull ELSE w END"""
    unit = "CASE WHEN secondary_designator0 = '' THEN '' WHEN u.short IS NOT NULL THEN " + ("'#'" if as_hash else "u.short") + " END"
    return f"""{_VOCAB},
s0 AS (SELECT addr_id, {sn} AS b FROM addresses a), s1 AS (SELECT DISTINCT b, coalesce({_pobox('b')}, b) AS s FROM s0),
s2 AS (SELECT b, s, unnest(range(1, len(string_split(s, ' ')) + 1)) AS k, len(string_split(s, ' ')) AS n FROM s1),
s3 AS (SELECT *, string_split(s, ' ')[k] AS w FROM s2),
s4 AS (SELECT s3.*, vr.street, vr.primary_name AS rprimary, vr.short AS rshort, vs.primary_name AS sprimary, vd.full_name AS dfull FROM s3 LEFT JOIN vr ON vr.k = {_key('w')} LEFT JOIN vs ON vs.k = {_key('w')} LEFT JOIN vd ON vd.k = upper(w)),
s5 AS (SELECT b, CASE WHEN any_value(n) = 1 THEN coalesce(any_value(sprimary), any_value(s)) ELSE string_agg({word}, ' ' ORDER BY s4.k) END AS text FROM s4 GROUP BY b),
{_highway_ctes("SELECT text FROM s5")},
s6 AS (SELECT s5.b, CASE WHEN s5.b = '' THEN '' ELSE coalesce(hw.highway, s5.text) END AS street FROM s5 LEFT JOIN hw ON hw.text = s5.text),
n0 AS (SELECT a.addr_id, a.type, {', '.join(f'{_free(f[n], mode)} AS {n}' for n in ('business_name', 'primary_number', 'secondary_number', 'city', 'country'))}, {_postal(f['postal'])} AS postal, {sn} AS b,
  {', '.join(f'{_base(f[n])} AS {n}0' for n in ('predirectional', 'postdirectional', 'street_suffix', 'secondary_designator', 'region'))} FROM addresses a),
n1 AS (SELECT n0.*, s6.street AS street_name, CASE WHEN predirectional0 = '' THEN '' ELSE d1.short END AS predirectional, CASE WHEN postdirectional0 = '' THEN '' ELSE d2.short END AS postdirectional, CASE WHEN street_suffix0 = '' THEN '' ELSE x.short END AS street_suffix,
  {unit} AS secondary_designator, CASE WHEN region0 = '' THEN '' ELSE r.short END AS region
  FROM n0 JOIN s6 ON s6.b = n0.b LEFT JOIN vd d1 ON d1.k = predirectional0 LEFT JOIN vd d2 ON d2.k = postdirectional0 LEFT JOIN vs x ON x.k = {_key('street_suffix0')} LEFT JOIN vu u ON u.k = upper(secondary_designator0) LEFT JOIN vr r ON r.k = {_key('region0')}),
done AS (SELECT *, CASE WHEN predirectional IS NULL THEN 'predirectional' WHEN postdirectional IS NULL THEN 'postdirectional' WHEN street_suffix IS NULL THEN 'street_suffix' WHEN secondary_designator IS NULL THEN 'secondary_designator' WHEN region IS NULL THEN 'region' END AS error FROM n1)"""


def _join(sep: str, *cols: str) -> str:
    return f"concat_ws({sep}, " + ", ".join(f"nullif({c}, '')" for c in cols) + ")"


_STREET = (f"CASE WHEN type IN ('po_box', 'military') THEN {_join(_q(' '), 'street_name', 'primary_number')} WHEN type = 'rural_route' THEN {_join(_q(' '), 'street_name', 'primary_number', 'secondary_designator', 'secondary_number')} "
           f"ELSE {_join(_q(' '), 'primary_number', 'predirectional', 'street_name', 'street_suffix', 'postdirectional', 'secondary_designator', 'secondary_number')} END")
_LASTLINE = _join("' '", "city", "region", "postal")


def _fuzzy(column: str, table: str, vocab: str, value: str, alias: str) -> str:
    return f"""WITH {vocab}, q AS (SELECT addr_id, {_key(column)} AS key FROM addresses), d AS (SELECT DISTINCT key FROM q WHERE strlen(key) > 3 AND key NOT IN (SELECT k FROM {table})),
near AS (SELECT d.key, t.k, t.{value} AS val, 1.0 - damerau_levenshtein(d.key, t.k)::DOUBLE / greatest(length(d.key), length(t.k)) AS sim FROM d JOIN {table} t ON abs(length(d.key) - length(t.k)) <= 0.3 * greatest(length(d.key), length(t.k)) + 0.000000001),
best AS (SELECT key, val FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sim DESC, k) AS nth FROM near WHERE sim >= 0.7) WHERE nth = 1)
SELECT q.addr_id, coalesce(t.{value}, best.val) AS {alias} FROM q LEFT JOIN {table} t ON t.k = q.key LEFT JOIN best ON best.key = q.key"""


def _fuzzy_ctes(column: str, table: str, value: str, name: str) -> str:
    """CTEs that end in name(k, value): the vocabulary and the nearest entry of each other key in addresses."""
    return f"""{name}0 AS (SELECT DISTINCT {_key(_base(f"coalesce({column}, '')"))} AS key FROM addresses), {name}1 AS (SELECT key FROM {name}0 WHERE strlen(key) > 3 AND key NOT IN (SELECT k FROM {table})),
{name}2 AS (SELECT d.key, t.k, t.{value} AS val, 1.0 - damerau_levenshtein(d.key, t.k)::DOUBLE / greatest(length(d.key), length(t.k)) AS sim FROM {name}1 d JOIN {table} t ON abs(length(d.key) - length(t.k)) <= 0.3 * greatest(length(d.key), length(t.k)) + 0.000000001),
{name} AS (SELECT k, {value} FROM {table} UNION ALL SELECT key, val FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sim DESC, k) AS nth FROM {name}2 WHERE sim >= 0.7) WHERE nth = 1)"""


def _candidates(kind: str, type_: str) -> str:
    """Line readings beside street claims that end before them; the parts' values are pivoted to fields."""
    test = {"po_box": _pobox, "rural_route": _rural, "military": _military}[kind]("txt")
    last = f" AND regexp_full_match({_collapse('upper(ltxt)')}, '{_LAST[1:-1]}') AND shape = 'city_region_postal' AND country = '' AND ccid IS NULL AND city = split_part({_collapse('upper(ltxt)')}, ' ', 1) AND region = split_part({_collapse('upper(ltxt)')}, ' ', 2) AND postal = split_part({_collapse('upper(ltxt)')}, ' ', 3)" if kind == "military" else ""
    return f"""{_LINE_HEAD}, cx AS MATERIALIZED (SELECT c.*, (SELECT string_agg(t.text, ' ' ORDER BY t.idx) FROM tok t WHERE t.rid = c.rid AND t.idx >= c.c_start AND t.idx < c.c_end) AS txt, (SELECT arg_min(p.value, p.part_no) FROM allp p WHERE p.rid = c.rid AND p.vocab = c.vocab AND p.claim = c.claim AND p.part_no = 1 AND p.start_at >= c.c_start AND p.start_at < c.c_end) AS second FROM cls c),
cy AS MATERIALIZED (SELECT * FROM cx WHERE {test} IS NOT NULL),
li AS (SELECT lines.*, row_number() OVER () AS lid, (SELECT string_agg(t.text, ' ' ORDER BY t.idx) FROM tok t WHERE t.rid = lines.rid AND t.idx >= start_at) AS ltxt FROM lines),
ca AS (SELECT l.addr_id, l.lid, least(l.confidence, c.confidence) AS low, l.gaps + CASE WHEN c.c_start > 0 THEN 1 ELSE 0 END + CASE WHEN c.c_end < l.start_at AND l.gaps = 0 THEN 1 ELSE 0 END AS n_gaps, l.city, l.region, l.postal, l.country, c.part, c.value, c.second, c.n_parts
  FROM li l JOIN cy c ON c.rid = l.rid AND c.c_end <= l.start_at WHERE TRUE{last})
SELECT addr_id, {_q(type_)} AS type, CAST(CASE WHEN n_gaps = 0 THEN low WHEN (CASE WHEN low > 90 THEN 0 WHEN low > 75 THEN 1 WHEN low > 50 THEN 2 ELSE 3 END) + n_gaps >= 3 THEN 50 WHEN (CASE WHEN low > 90 THEN 0 WHEN low > 75 THEN 1 WHEN low > 50 THEN 2 ELSE 3 END) + n_gaps = 2 THEN 75 ELSE 90 END AS INTEGER) AS confidence, CAST(n_gaps AS INTEGER) AS n_leftover,
  '' AS business_name, coalesce(CASE WHEN n_parts = 2 THEN second END, '') AS primary_number, '' AS predirectional, CASE WHEN part = 'street_name' THEN value ELSE '' END AS street_name, '' AS street_suffix, '' AS postdirectional, '' AS secondary_designator, '' AS secondary_number, city, region, postal, country FROM ca"""


def _parse_ctes() -> str:
    """CTEs that end in parsed(addr_id, type, fields..., confidence): one row for each raw text."""
    tests = " UNION ALL ".join(f"SELECT *, {no} AS type_no, {_q(kind)} AS type FROM cx WHERE {test('txt')} IS NOT NULL" for no, (kind, test) in enumerate((("po_box", _pobox), ("rural_route", _rural), ("military", _military))))
    last = _collapse("upper(ltxt)")
    overseas = f"(regexp_full_match({last}, '{_LAST[1:-1]}') AND shape = 'city_region_postal' AND country = '' AND ccid IS NULL AND city = split_part({last}, ' ', 1) AND region = split_part({last}, ' ', 2) AND postal = split_part({last}, ' ', 3))"
    step = "(CASE WHEN low > 90 THEN 0 WHEN low > 75 THEN 1 WHEN low > 50 THEN 2 ELSE 3 END) + n_gaps"
    direction = "N|S|E|W|NE|NW|SE|SW|NORTH ?EAST|NORTH ?WEST|SOUTH ?EAST|SOUTH ?WEST|NORTH|SOUTH|EAST|WEST"
    words = lambda keys: "|".join(sorted(keys, key=lambda k: (-len(k), k)))
    pattern = rf"^([0-9][0-9A-Z/-]*)(?: ({direction})\.?)?(?: (.+?))??(?: ({words(v.suffixes())})\.?)?(?: ({direction})\.?)?(?: ({words(v.units())})\.?(?: ?([0-9A-Z-]+))?)?$"
    got = ", ".join(f"regexp_extract(t, '{pattern}', {i}) AS {n}" for i, n in enumerate(("num", "pre", "name", "suf", "post", "unit", "unit_no"), 1))
    fields = ", ".join(_FIELDS)
    return f"""{_VOCAB}, {_TOKENS}, {_LINES},
od AS (SELECT cid, row_number() OVER (PARTITION BY rid ORDER BY CASE vocab WHEN 'region' THEN 0 WHEN 'postal' THEN 1 WHEN 'country' THEN 2 WHEN 'pobox' THEN 3 WHEN 'rural_route' THEN 4 ELSE 5 END, c_start, CASE WHEN vocab IN ('region', 'postal', 'country') THEN -c_end ELSE c_end END, claim) AS o FROM cls),
cx AS MATERIALIZED (SELECT c.*, od.o, (SELECT string_agg(t.text, ' ' ORDER BY t.idx) FROM tok t WHERE t.rid = c.rid AND t.idx >= c.c_start AND t.idx < c.c_end) AS txt, (SELECT arg_min(p.value, p.part_no) FROM allp p WHERE p.rid = c.rid AND p.vocab = c.vocab AND p.claim = c.claim AND p.part_no = 1 AND p.start_at >= c.c_start AND p.start_at < c.c_end) AS second FROM cls c JOIN od USING (cid)),
cy AS MATERIALIZED ({tests}),
li AS MATERIALIZED (SELECT lines.*, row_number() OVER (PARTITION BY lines.rid ORDER BY coalesce(oc.o, -1), shape = 'city_region', coalesce(op.o, -1), CASE shape WHEN 'city_region_postal' THEN 0 WHEN 'postal' THEN 1 ELSE 2 END, coalesce(og.o, -1), start_at) AS line_no, (SELECT string_agg(t.text, ' ' ORDER BY t.idx) FROM tok t WHERE t.rid = lines.rid AND t.idx >= start_at) AS ltxt
  FROM lines LEFT JOIN od oc ON oc.cid = ccid LEFT JOIN od op ON op.cid = pcid LEFT JOIN od og ON og.cid = rcid),
ca AS (SELECT l.rid, c.type, c.type_no, l.length AS extent, l.line_no, c.o AS claim_no, least(l.confidence, c.confidence) AS low, l.gaps + CASE WHEN c.c_start > 0 THEN 1 ELSE 0 END + CASE WHEN c.c_end < l.start_at AND l.gaps = 0 THEN 1 ELSE 0 END AS n_gaps, l.city, l.region, l.postal, l.country, c.part, c.value, c.second, c.n_parts
  FROM li l JOIN cy c ON c.rid = l.rid AND c.c_end <= l.start_at WHERE c.type <> 'military' OR {overseas}),
st AS (SELECT x.rid, x.start_at, (SELECT string_agg(t.text, ' ' ORDER BY t.idx) FROM tok t WHERE t.rid = x.rid AND t.idx >= le.line_start AND t.idx < x.start_at) AS text, (SELECT string_agg(t.text, ' ' ORDER BY t.idx) FROM tok t WHERE t.rid = x.rid AND t.idx < le.line_start) AS before
  FROM (SELECT DISTINCT rid, start_at FROM lines WHERE start_at > 0) x JOIN tok q ON q.rid = x.rid AND q.idx = x.start_at - 1 JOIN le ON le.rid = q.rid AND le.line = q.line),
qt AS (SELECT *, upper(regexp_replace(text, '[.,]', '', 'g')) AS t FROM st),
qg AS MATERIALIZED (SELECT rid, start_at, before, {got} FROM qt WHERE regexp_matches(t, '{pattern}')),
qs AS (SELECT rid, start_at, coalesce(upper(before), '') AS business_name, num AS primary_number, CASE WHEN name = '' THEN '' ELSE pre END AS predirectional, CASE WHEN name = '' THEN pre ELSE name END AS street_name, suf AS street_suffix, post AS postdirectional, unit AS secondary_designator, unit_no AS secondary_number  FROM qg WHERE name <> '' OR pre <> ''),
whole AS (SELECT rid, type, type_no, CAST(CASE WHEN n_gaps = 0 THEN low WHEN {step} >= 3 THEN 50 WHEN {step} = 2 THEN 75 ELSE 90 END AS INTEGER) AS confidence, 0 AS clear, extent, line_no, claim_no,
    '' AS business_name, coalesce(CASE WHEN n_parts = 2 THEN second END, '') AS primary_number, '' AS predirectional, CASE WHEN part = 'street_name' THEN value ELSE '' END AS street_name, '' AS street_suffix, '' AS postdirectional, '' AS secondary_designator, '' AS secondary_number, city, region, postal, country FROM ca
  UNION ALL SELECT l.rid, NULL, 9, CAST(least(l.confidence, 75) AS INTEGER), l.confidence, l.length, l.line_no, 0, business_name, primary_number, predirectional, street_name, street_suffix, postdirectional, secondary_designator, secondary_number, city, region, postal, country FROM li l JOIN qs ON qs.rid = l.rid AND qs.start_at = l.start_at),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY confidence DESC, type_no, clear DESC, extent DESC, line_no, claim_no) AS nth FROM whole) WHERE nth = 1),
parsed AS (SELECT rr.addr_id, top.type, {', '.join(f"coalesce(top.{n}, '') AS {n}" for n in _FIELDS)}, top.confidence FROM rr LEFT JOIN top ON top.rid = rr.rid)"""


def core_oracle_sql() -> dict[str, str]:
    rr = "concat_ws(' ', a.street_name, a.primary_number)"
    last = _collapse("upper(concat_ws(' ', a.city, a.region, a.postal))")
    pr_types = _table("vt", "k,full_name,short", [(k, p, s) for p, s in v.PR_STREET_TYPES.items() for k in (p, s)])
    pr_second = _table("v2", "k,short", list((v.PR_SECONDARY | {s: s for s in v.PR_SECONDARY.values()}).items()))
    digits = "regexp_replace(a.postal, '[^0-9]', '', 'g')"
    pr = f"(length({digits}) >= 5 AND left({digits}, 3) IN ('006','007','009'))"
    hw = _highway_ctes("SELECT street_name AS text FROM addresses WHERE street_name IS NOT NULL")
    out = {
        "collapse_space": _scalar(f"{_collapse('a.city')} AS city, {_collapse('a.street_name')} AS street_name"),
        "strip_punctuation": _scalar(f"{_strip('a.street_name')} AS plain, {_strip('a.street_name', hyphen=True)} AS hyphen, {_strip('a.street_name', slash=True)} AS slash, {_strip('a.street_name', True, True)} AS both"),
        "normalize_unknown": _scalar(f"{_unknown('a.city')} AS city, {_unknown('a.region')} AS region"),
        "base_field": _scalar(f"{_base('a.city')} AS city, {_base('a.street_name')} AS street_name"),
        "join_non_empty": _scalar(_join("' '", "a.primary_number", "a.predirectional", "a.street_name", "a.street_suffix") + " AS joined"),
        "diacritics_substitute": _scalar(f"{_substitute('a.city')} AS city, {_substitute('a.street_name')} AS street_name"),
        "diacritics_transliterate": _scalar(f"{_transliterate('a.city')} AS city"),
        "diacritics_normalize": _scalar(f"a.business_name AS keep, {_substitute('a.business_name')} AS substitute, {_transliterate('a.business_name')} AS transliterate"),
        "upper_unknown": _scalar(f"upper({_unknown('a.city')}) AS city, upper({_unknown('a.region')}) AS region"),
        "region_alternates": _scalar("vr.alternates", _table("vr", "k,alternates", [(k, "|".join(v.spellings_of(v.regions())[r])) for k, r in v.regions().items()]), f"LEFT JOIN vr ON vr.k = {_key('a.region')}"),
        "suffix_info": _scalar("vs.short, vs.primary_name AS \"primary\", vs.alternates", _table("vs", "k,primary_name,short,alternates", [(k, *x, "|".join(v.spellings_of(v.suffixes())[x])) for k, x in v.suffixes().items()]), f"LEFT JOIN vs ON vs.k = {_key('a.street_suffix')}"),
        "unit_normalize": _scalar("vu.short AS unit", UNIT, "LEFT JOIN vu ON vu.k = upper(a.secondary_designator)"),
        "token_join": f"WITH {_TOKENS} SELECT addr_id, line, string_agg(text, ' ' ORDER BY idx) AS text FROM tok GROUP BY rid, addr_id, line",
        "line_start": f"WITH {_TOKENS} SELECT tok.addr_id, tok.idx, le.line_start FROM tok JOIN le ON le.rid = tok.rid AND le.line = tok.line",
        "claim_extent": f"{_LINE_HEAD} SELECT addr_id, vocab, CAST(c_start AS INTEGER) AS start_at, CAST(c_end AS INTEGER) AS end_at, CAST(c_end - c_start AS INTEGER) AS length FROM cls",
        "demote": f"{_LINE_HEAD} SELECT addr_id, vocab, CAST(c_start AS INTEGER) AS start_at, CAST(confidence AS INTEGER) AS confidence, CASE confidence WHEN 100 THEN 90 WHEN 90 THEN 75 ELSE 50 END AS down_1, CASE confidence WHEN 100 THEN 75 ELSE 50 END AS down_2, 50 AS down_3 FROM cls",
        "claims_ending_at": f"{_LINE_HEAD} SELECT c.addr_id, c.vocab, CAST(c.c_start AS INTEGER) AS start_at, c.part, c.value FROM cls c JOIN cnt ON cnt.rid = c.rid AND c.c_end = cnt.n WHERE c.n_parts = 1",
        "city_readings": f"{_LINE_HEAD} SELECT addr_id, CAST(start_at AS INTEGER) AS start_at, city, count(*) AS n_readings FROM lines WHERE shape <> 'postal' GROUP BY addr_id, start_at, city",
        "free_text_field": _scalar(f"{_free('a.city', 'sub')} AS city"),
        "region_normalize": _scalar("vr.short AS region", REGION, f"LEFT JOIN vr ON vr.k = {_key('a.region')}"),
        "region_info": _scalar("vr.short, vr.primary_name AS \"primary\", CASE WHEN vr.street THEN vr.primary_name END AS street_name", REGION, f"LEFT JOIN vr ON vr.k = {_key('a.region')}"),
        "suffix_primary": _scalar("vs.primary_name AS suffix", SUFFIX, f"LEFT JOIN vs ON vs.k = {_key('a.street_suffix')}"),
        "suffix_short": _scalar("vs.short AS suffix", SUFFIX, f"LEFT JOIN vs ON vs.k = {_key('a.street_suffix')}"),
        "directional_abbrev": _scalar("vd.short AS direction", DIRECTION, "LEFT JOIN vd ON vd.k = upper(a.predirectional)"),
        "directional_full": _scalar("vd.full_name AS direction", DIRECTION, "LEFT JOIN vd ON vd.k = upper(a.predirectional)"),
        "unit_info": _scalar("vu.short AS unit, vu.numbered", UNIT, "LEFT JOIN vu ON vu.k = upper(a.secondary_designator)"),
        "pr_street_type_full": _scalar("vt.full_name AS street_type", pr_types, f"LEFT JOIN vt ON vt.k = upper({_collapse('a.street_suffix')})"),
        "pr_street_type_abbrev": _scalar("vt.short AS street_type", pr_types, f"LEFT JOIN vt ON vt.k = upper({_collapse('a.street_suffix')})"),
        "pr_secondary": _scalar("v2.short AS secondary", pr_second, f"LEFT JOIN v2 ON v2.k = upper({_collapse('a.secondary_designator')})"),
        "pr_postal": _scalar(f"{pr} AS pr"),
        "pr_dialect": _scalar(f"coalesce(upper({_collapse('a.region')}) = 'PR', FALSE) OR coalesce({pr}, FALSE) AS pr"),
        "postal_normalize": _scalar(f"{_postal('a.postal')} AS postal"),
        "postal_classify": f"SELECT addr_id, postal, CAST(CASE WHEN postal IS NULL THEN NULL WHEN length(postal) = 5 THEN 50 ELSE 90 END AS INTEGER) AS confidence FROM (SELECT a.addr_id, {_classify('a.postal')} AS postal FROM addresses a)",
        "country_normalize": _scalar(f"CASE WHEN a.country IS NULL THEN NULL ELSE {_country('a.country')} END AS country"),
        "pobox_normalize": _scalar(f"{_pobox(rr)} AS box"),
        "rural_route_normalize": _scalar(f"{_rural(rr)} AS route"),
        "military_street": _scalar(f"{_military(rr)} AS street"),
        "military_last_line": _scalar(", ".join(f"CASE WHEN regexp_matches({last}, '{_LAST}') THEN split_part({last}, ' ', {i}) END AS {n}" for i, n in ((1, "city"), (2, "region"), (3, "postal")))),
        "highway_normalize": f"WITH {hw} SELECT a.addr_id, hw.highway FROM addresses a LEFT JOIN hw ON hw.text = a.street_name",
        "tokenize": f"WITH {_TOKENS} SELECT addr_id, idx, text, line, of_lines, position, follows_comma FROM tok",
        "line_end": f"WITH {_TOKENS} SELECT tok.addr_id, tok.idx, le.line_end FROM tok JOIN le ON le.rid = tok.rid AND le.line = tok.line",
        "region_fuzzy": _fuzzy("region", "vr", REGION, "short", "region"),
        "suffix_short_fuzzy": _fuzzy("street_suffix", "vs", SUFFIX, "short", "suffix"),
        "suffix_primary_fuzzy": _fuzzy("street_suffix", "vs", SUFFIX, "primary_name", "suffix"),
    }
    out |= {f"claims_{n}": _claims_sql(n) for n in _CLAIMS}
    for name, (mode, as_hash) in {"content": ("keep", False), "matching": ("sub", True)}.items():
        fields = ", ".join(f"CASE WHEN error IS NULL THEN {n} END AS {n}" for n in _FIELDS)
        out[f"normalize_address_{name}"] = f"WITH {_normal_ctes(mode, as_hash)} SELECT addr_id, {fields}, error FROM done"
    out["normalize_address_untyped"] = out["normalize_address_content"]
    near = _fuzzy_ctes("region", "vr", "short", "zr") + ", " + _fuzzy_ctes("street_suffix", "vs", "short", "zs")
    content = _normal_ctes("keep", False)
    loose = content.replace(_VOCAB + ",", f"{_VOCAB}, {near},").replace(f"LEFT JOIN vs x ON x.k = {_key('street_suffix0')}", f"LEFT JOIN zs x ON x.k = {_key('street_suffix0')}").replace(f"LEFT JOIN vr r ON r.k = {_key('region0')}", f"LEFT JOIN zr r ON r.k = {_key('region0')}")
    fields = ", ".join(f"CASE WHEN error IS NULL THEN {n} END AS {n}" for n in _FIELDS)
    out["normalize_address_fuzzy"] = f"WITH {loose} SELECT addr_id, {fields}, error FROM done"
    rural = _join(_q(" "), "street_name", "primary_number", "secondary_designator", "secondary_number")
    out["as_rural_route"] = f"WITH {content} SELECT addr_id, 'rural_route' AS type, {rural} AS street_line FROM done WHERE error IS NULL"
    out["format_street_line"] = f"WITH {content} SELECT addr_id, {_STREET} AS street_line FROM done WHERE error IS NULL"
    out["format_last_line"] = f"WITH {content} SELECT addr_id, {_LASTLINE} AS last_line FROM done WHERE error IS NULL"
    words = r"regexp_extract_all(replace(upper(coalesce(raw, '')), 'FARM TO MARKET', 'FM'), '[^ \t\n\f\r,]+')"
    out["external_parser"] = f"SELECT addr_id, coalesce({words}[1], '') AS primary_number, coalesce({words}[-1], '') AS postal, '' AS street_name, CAST(NULL AS VARCHAR) AS error FROM raw_addresses"
    up = lambda c: f"coalesce(upper({c}), '')"
    out["address_from_labels"] = f"""WITH {UNIT}, u0 AS (SELECT *, upper(nullif(concat_ws(' ', secondary_designator, secondary_number), '')) AS unit FROM addresses), u1 AS (SELECT *, regexp_extract(unit, '^([0-9A-Za-z_]+|[^0-9A-Za-z_ ]+)', 1) AS head FROM u0)
SELECT addr_id, {up('business_name')} AS business_name, {up('primary_number')} AS primary_number, '' AS predirectional, {up('street_name')} AS street_name, '' AS street_suffix, '' AS postdirectional, coalesce(vu.short, '') AS secondary_designator, CASE WHEN vu.numbered THEN trim(substr(unit, length(head) + 1), ' ') ELSE '' END AS secondary_number,
  {up('city')} AS city, {up('region')} AS region, {up('postal')} AS postal, {up('country')} AS country, CASE WHEN unit IS NOT NULL AND vu.short IS NULL THEN 'secondary_designator' END AS error FROM u1 LEFT JOIN vu ON vu.k = upper(head)"""
    road = "trim(regexp_replace(upper(concat_ws(' ', predirectional, street_name, street_suffix, postdirectional)), '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ')"
    out["split_road"] = f"""WITH {_VOCAB}, r0 AS (SELECT addr_id, {road} AS road FROM addresses), r1 AS (SELECT DISTINCT road, string_split(road, ' ') AS w FROM r0), r2 AS (SELECT *, len(w) AS n, coalesce(w[1], '') AS a1, coalesce(w[2], '') AS a2, coalesce(w[-1], '') AS z1, CASE WHEN len(w) > 1 THEN w[-2] ELSE '' END AS z2 FROM r1),
m AS (SELECT road, max(i) AS spot FROM (SELECT road, unnest(range(len(w))) AS i, unnest(w) AS x FROM r1) JOIN vs ON vs.k = {_key('x')} GROUP BY road),
r3 AS (SELECT r2.*, coalesce(m.spot, -1) AS spot, d2.short AS two, d1.short AS one, e2.short AS end2, e1.short AS end1, vr.short AS state, CASE WHEN m.spot IS NULL THEN n ELSE m.spot - 1 END AS ahead, CASE WHEN m.spot IS NULL THEN n ELSE n - 1 - m.spot END AS behind, greatest(length(coalesce(e2.short, '')), length(coalesce(e1.short, ''))) AS room
  FROM r2 LEFT JOIN m USING (road) LEFT JOIN vd d2 ON d2.k = a1 || a2 LEFT JOIN vd d1 ON d1.k = a1 LEFT JOIN vd e2 ON e2.k = z2 || z1 LEFT JOIN vd e1 ON e1.k = z1 LEFT JOIN vr ON vr.k = {_key("a1 || ' ' || a2")}),
r4 AS (SELECT *, CASE WHEN two IS NOT NULL AND (ahead > 2 OR ahead = 2 AND behind >= room) THEN 2 WHEN one IS NOT NULL AND state IS NULL AND (ahead > 1 OR ahead = 1 AND behind >= room) THEN 1 ELSE 0 END AS ld, CASE WHEN end2 IS NOT NULL THEN 2 WHEN end1 IS NOT NULL THEN 1 ELSE 0 END AS tl FROM r3),
middle AS (SELECT road, string_agg(CASE WHEN i = spot AND n - ld - tl > 1 THEN coalesce(vs.short, x) ELSE x END, ' ' ORDER BY i) AS name FROM (SELECT *, unnest(range(n)) AS i, unnest(w) AS x FROM r4) LEFT JOIN vs ON vs.k = {_key('x')} WHERE i >= ld AND i < n - tl GROUP BY road)
SELECT r0.addr_id, CASE WHEN n < 2 OR ld = 0 THEN '' WHEN ld = 2 THEN two ELSE one END AS predirectional, CASE WHEN n < 2 THEN w[1] ELSE coalesce(middle.name, '') END AS street_name, CASE WHEN n < 2 OR tl = 0 THEN '' WHEN tl = 2 THEN end2 ELSE end1 END AS postdirectional FROM r0 JOIN r4 USING (road) LEFT JOIN middle USING (road)"""
    out["parse_verified"] = f"WITH {_parse_ctes()} SELECT addr_id, region, postal, CASE WHEN region = '' OR postal = '' THEN least(confidence, 50) ELSE confidence END AS confidence FROM parsed"
    content, match = _normal_ctes("keep", False), _normal_ctes("sub", True)
    out["format_address"] = f"WITH {content}, f AS (SELECT addr_id, business_name, {_STREET} AS street_line, {_LASTLINE} AS last_line FROM done WHERE error IS NULL) SELECT addr_id, street_line, last_line, {_join('chr(10)', 'business_name', 'street_line', 'last_line')} AS formatted, {_join(_q(' '), 'business_name', 'street_line', 'last_line')} AS single_line FROM f"
    out["match_keys"] = f"WITH {match}, f AS (SELECT business_name, {_STREET} AS street_line, {_LASTLINE} AS last_line FROM done WHERE error IS NULL) SELECT {_join(_q(' '), 'business_name', 'street_line', 'last_line')} AS match_key, count(*) AS n_rows FROM f GROUP BY 1"
    out["error_rates"] = f"WITH {content} SELECT coalesce(error, 'none') AS error, count(*) AS n_rows FROM done GROUP BY 1"
    same = " AND ".join(f"c.{n} IS NOT DISTINCT FROM m.{n}" for n in _FIELDS)
    out["address_equals"] = f"WITH c AS (SELECT * FROM (WITH {content} SELECT * FROM done)), m AS (SELECT * FROM (WITH {match} SELECT * FROM done)) SELECT c.addr_id, {same} AS equal FROM c JOIN m ON m.addr_id = c.addr_id WHERE c.error IS NULL"
    two = lambda *n: " UNION ALL ".join(f"SELECT *, {_q(x)} AS vocab FROM ({_CLAIMS[x]})" for x in n)
    out["claim_overlaps"] = f"WITH {_VOCAB}, {_TOKENS}, r AS ({_CLAIMS['region']}), s AS ({_CLAIMS['suffix']}) SELECT r.addr_id, r.start_at AS region_start, CAST(r.start_at + r.length AS INTEGER) AS region_end, s.start_at AS suffix_start, r.part FROM r JOIN s ON s.rid = r.rid AND s.start_at < r.start_at + r.length AND r.start_at < s.start_at + s.length"
    out["claim_compare_rank"] = f"WITH {_VOCAB}, {_TOKENS}, x AS ({two('region', 'postal')}) SELECT addr_id, CAST(confidence AS INTEGER) AS confidence, start_at, value FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY confidence DESC, length DESC, vocab, start_at, claim) AS nth FROM x) WHERE nth = 1"
    out["span_gaps"] = f"""WITH {_VOCAB}, {_TOKENS}, x AS ({two('region', 'postal', 'suffix')}), free AS (SELECT t.rid, t.addr_id, t.idx FROM tok t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.rid = t.rid AND x.start_at <= t.idx AND t.idx < x.start_at + x.length)),
isl AS (SELECT *, idx - row_number() OVER (PARTITION BY rid ORDER BY idx) AS g FROM free) SELECT addr_id, CAST(min(idx) AS INTEGER) AS start_at, CAST(count(*) AS INTEGER) AS length FROM isl GROUP BY rid, addr_id, g"""
    out["line_claims"] = f"{_LINE_HEAD} SELECT addr_id, shape, CAST(start_at AS INTEGER) AS start_at, CAST(length AS INTEGER) AS length, CAST(confidence AS INTEGER) AS confidence, city, region, postal, country, CAST(gaps AS INTEGER) AS n_leftover FROM lines"
    out["line_rejections"] = f"""{_LINE_HEAD} SELECT l.addr_id, l.shape, CAST(l.start_at AS INTEGER) AS start_at, CAST(l.length AS INTEGER) AS length, CAST((SELECT count(*) FROM cls c WHERE c.rid = l.rid AND c.c_end > l.start_at AND c.c_start < l.n
  AND c.cid IS DISTINCT FROM l.ccid AND c.cid IS DISTINCT FROM l.pcid AND c.cid IS DISTINCT FROM l.rcid) AS INTEGER) AS n_rejected FROM lines l"""
    out["rejected_claims"] = f"""{_LINE_HEAD} SELECT l.addr_id, l.shape, CAST(l.start_at AS INTEGER) AS line_start, c.vocab, CAST(c.c_start AS INTEGER) AS claim_start, CAST(c.c_end AS INTEGER) AS claim_end, CAST(c.confidence AS INTEGER) AS confidence FROM lines l JOIN cls c ON c.rid = l.rid AND c.c_end > l.start_at AND c.c_start < l.n
  AND c.cid IS DISTINCT FROM l.ccid AND c.cid IS DISTINCT FROM l.pcid AND c.cid IS DISTINCT FROM l.rcid"""
    out["line_best"] = f"{_LINE_HEAD} SELECT addr_id, CAST(confidence AS INTEGER) AS confidence, CAST(start_at AS INTEGER) AS start_at, CAST(length AS INTEGER) AS length FROM (SELECT DISTINCT rid, addr_id, confidence, start_at, length, row_number() OVER (PARTITION BY rid ORDER BY confidence DESC, length DESC) AS nth FROM lines) WHERE nth = 1"
    for name, kind in (("pobox", "po_box"), ("rural_route", "rural_route"), ("military", "military")):
        out[f"candidates_{name}"] = _candidates(kind, kind)
    out["parse_addresses"] = f"WITH {_parse_ctes()} SELECT * FROM parsed"
    text = _normal_ctes("keep", False).replace("FROM addresses a", "FROM parsed a").removeprefix(_VOCAB + ",")
    out["normalize_text"] = f"WITH {_parse_ctes()}, {text} SELECT addr_id, CASE WHEN error IS NULL THEN {_join('chr(10)', 'business_name', _STREET, _LASTLINE)} END AS formatted, error FROM done"
    both = " UNION ALL ".join(f"SELECT addr_id, confidence FROM ({out[f'candidates_{n}']})" for n in ("pobox", "rural_route", "military"))
    out["candidate_best"] = f"SELECT addr_id, max(confidence) AS confidence, count(*) AS n_candidates FROM ({both}) GROUP BY addr_id"
    hits = " UNION ALL ".join(f"SELECT {_q(n)} AS vocab, confidence FROM ({_claims_sql(n)}) WHERE part_no = 0" for n in _CLAIMS)
    out["vocabulary_hits"] = f"SELECT vocab, confidence, count(*) AS n_claims FROM ({hits}) GROUP BY vocab, confidence"
    return out
