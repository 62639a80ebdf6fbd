"""Names and signals of the posts in SQL, written apart from the engine's own expressions.

Every signal has its condition here, in the order in which the engine lists signals; the SQL works
on tables of words, names, comments and history items where the engine works on arrays.
"""

from __future__ import annotations

from ..functions import fixed as P
from .corpus import AS_OF, ELSEWHERE, POSTS_SQL, SAYINGS, SITES, as_sql_list, quote, sql_host, sql_shadow

_STOP, _OFF, _TOOLS = as_sql_list(P.NAME_STOPWORDS), as_sql_list(P.NON_PRODUCT_HOSTS), as_sql_list(sorted({t.lower() for t in P.FAMILIAR_TOOLS}))
_WS = "E' \\t\\r\\n'"


def once(list_: str) -> str:
    """The list without repeats, in order."""
    return f"list_filter({list_}, lambda o, i: list_position({list_}, o) = i)"


def has(pattern: str, on: str = "x") -> str:
    return f"regexp_matches({on}, {quote(pattern)})"


def times(pattern: str, on: str = "b") -> str:
    return f"len(regexp_extract_all({on}, {quote(pattern)}))"


def place(pattern: str, on: str) -> str:
    """Where the first match begins as a share of the text; -1 if there is none."""
    return f"CASE WHEN {has(pattern, on)} THEN length(regexp_extract({on}, {quote('(?s)^(.*?)(?:' + pattern + ')')}, 1)) / greatest(1, length({on})) ELSE -1.0 END"


def last_place(pattern: str, on: str) -> str:
    return f"CASE WHEN {has(pattern, on)} THEN (length({on}) - length(regexp_split_to_array({on}, {quote(pattern)})[-1]) - length(regexp_extract_all({on}, {quote(pattern)})[-1])) / greatest(1, length({on})) ELSE -1.0 END"


def named(text: str, name: str) -> str:
    return f"regexp_matches({text}, '(?i)\\b' || {name} || '\\b')"


def sentences(x: str) -> str:
    cut = f"string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))"
    return f"list_filter(list_transform({cut}, lambda s: trim(s, {_WS})), lambda s: s <> '')"


def _or(patterns, on: str) -> str:
    return "(" + " OR ".join(has(p, on) for p in patterns) + ")"


_CAP = "(regexp_full_match({w}, '[A-Z][a-zA-Z0-9]{{1,}}') AND NOT regexp_full_match({w}, '[A-Z]+'))"
_WHOLE = "(regexp_full_match(w, '[A-Z][a-zA-Z0-9]{2,}') AND NOT regexp_full_match(w, '[A-Z]+'))"
_LABEL = "CASE WHEN len(p) >= 3 AND p[-2] IN ('co', 'com', 'org', 'net') THEN p[-3] WHEN len(p) >= 2 THEN p[-2] ELSE p[1] END"
_CAPITAL = "upper(left({x}, 1)) || substr({x}, 2)"

NAMES_SQL = f"""{POSTS_SQL},
found AS (SELECT doc_id, list_concat(CASE WHEN link IS NULL THEN []::VARCHAR[] ELSE [link] END, list_transform(regexp_extract_all(body1, '(?i)\\bhttps?://[^\\s<>()"'']+'), lambda u: regexp_replace(u, '[.,;:!?)]+$', ''))) AS l FROM shadows),
webs AS (SELECT doc_id, {once("l")} AS links FROM found),
goods AS (SELECT doc_id, links, list_filter(links, lambda u: {sql_host("u")} <> '' AND NOT list_contains({_OFF}, {sql_host("u")}) AND NOT ends_with({sql_host("u")}, '.reddit.com')) AS product FROM webs),
outs AS (SELECT *, list_transform(product, lambda u: {sql_host("u")}) AS link_hosts, CASE WHEN doc_id % 6 = 1 THEN list_filter(['example' || doc_id % 3 || '.io', 'reddit.com'], lambda h: NOT list_contains({_OFF}, h)) ELSE [] END AS outbound FROM goods),
joined AS (SELECT *, list_concat(link_hosts, outbound) AS l FROM outs),
hosted AS (SELECT doc_id, links, product, link_hosts, {once("l")} AS hosts FROM joined),
texts AS (SELECT doc_id, title1 || chr(10) || body1 AS txt FROM shadows),
sents AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS si FROM (SELECT doc_id, {sentences("txt")} AS l FROM texts)),
worded AS (SELECT doc_id, si, list_transform(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[("''\\[]+|[)"''\\],.!?:;]+$', '', 'g')) AS ws FROM sents),
toks AS (SELECT doc_id, si, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM worded),
humps AS (SELECT doc_id, unnest(l) AS name, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(txt, '\\b([A-Za-z][a-z]+[A-Z][A-Za-z0-9]*)\\b') AS l FROM texts)),
dotted AS (SELECT doc_id, unnest(l) AS name, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_transform(regexp_extract_all(txt, '(?i)\\b([a-z0-9-]{{3,}})\\.(?:ai|io|app|co|so|dev|xyz|me|tech|tools)\\b', 1), lambda x: {_CAPITAL.format(x="lower(x)")}) AS l FROM texts)),
said AS (SELECT doc_id, name, 1000000000 + i AS seq FROM humps UNION ALL SELECT doc_id, name, 2000000000 + i FROM dotted UNION ALL SELECT doc_id, w, 3000000000 + si * 50000 + k FROM toks WHERE k > 1 AND {_WHOLE}),
base AS (SELECT doc_id, name, count(*) AS n, min(seq) AS seq FROM said WHERE length(name) >= 3 AND NOT list_contains({_STOP}, lower(name)) GROUP BY doc_id, name),
shapes AS (SELECT doc_id, si, regexp_extract_all(array_to_string(list_transform(ws, lambda w: CASE WHEN NOT {_CAP.format(w="w")} THEN '.' WHEN list_contains({_STOP}, lower(w)) THEN '>' || w ELSE '<' || w END), ' '), '<[A-Za-z0-9]+(?: [<>][A-Za-z0-9]+){{1,2}}') AS l FROM worded),
phr AS (SELECT doc_id, phrase, count(*) AS n, min(seq) AS seq FROM (SELECT doc_id, regexp_replace(unnest(l), '[<>]', '', 'g') AS phrase, si * 50000 + generate_subscripts(l, 1) AS seq FROM shapes) GROUP BY doc_id, phrase),
parts AS (SELECT doc_id, seq, n, unnest(string_split(phrase, ' ')) AS w, generate_subscripts(string_split(phrase, ' '), 1) AS i FROM phr),
charged AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id, w ORDER BY seq, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM parts),
paid AS (SELECT c.doc_id, c.w, sum(c.n) AS total, sum(CASE WHEN before < coalesce(b.n, 0) THEN c.n ELSE 0 END) AS opened FROM charged c LEFT JOIN base b ON b.doc_id = c.doc_id AND b.name = c.w GROUP BY c.doc_id, c.w),
n0 AS (SELECT b.doc_id, name, n - coalesce(total, 0) AS n, seq FROM base b LEFT JOIN paid p ON p.doc_id = b.doc_id AND p.w = b.name WHERE n > coalesce(total, 0) UNION ALL SELECT doc_id, phrase, n, 20000000000 + seq FROM phr),
op AS (SELECT o.doc_id, o.w, o.n - coalesce(opened, 0) AS n, seq FROM (SELECT doc_id, w, count(*) AS n, min(si) AS seq FROM toks WHERE k = 1 AND {_WHOLE} GROUP BY doc_id, w) o LEFT JOIN paid p ON p.doc_id = o.doc_id AND p.w = o.w WHERE o.n > coalesce(opened, 0) AND NOT list_contains({_STOP}, lower(o.w))),
op1 AS (SELECT o.doc_id, o.w AS name, o.n, 40000000000 + o.seq AS seq FROM op o WHERE o.n >= 3 OR EXISTS (SELECT 1 FROM n0 WHERE n0.doc_id = o.doc_id AND lower(n0.name) = lower(o.w)) OR EXISTS (SELECT 1 FROM op q WHERE q.doc_id = o.doc_id AND lower(q.w) = lower(o.w) AND q.seq < o.seq AND q.n >= 3)),
n1 AS (SELECT doc_id, name, sum(n) AS n, min(seq) AS seq FROM (SELECT * FROM n0 UNION ALL SELECT * FROM op1) GROUP BY doc_id, name),
labels_ AS (SELECT doc_id, {_LABEL} AS label, min(i) AS i FROM (SELECT doc_id, string_split(h, '.') AS p, h, i FROM (SELECT doc_id, unnest(hosts) AS h, generate_subscripts(hosts, 1) AS i FROM hosted)) WHERE NOT list_contains({_OFF}, h) GROUP BY ALL),
heard AS (SELECT l.doc_id, label, i, len(regexp_extract_all(txt, '(?i)\\b' || label || '\\b')) AS n FROM labels_ l JOIN texts USING (doc_id) WHERE length(label) >= 3),
aimed AS (SELECT h.doc_id, label, i, h.n, (SELECT arg_min(n1.name, n1.seq) FROM n1 WHERE n1.doc_id = h.doc_id AND lower(n1.name) = lower(label)) AS name FROM heard h WHERE h.n > 0),
n2 AS (SELECT n1.doc_id, n1.name, greatest(n1.n, coalesce((SELECT max(a.n) FROM aimed a WHERE a.doc_id = n1.doc_id AND a.name = n1.name), 0)) AS n, seq FROM n1 UNION ALL SELECT doc_id, {_CAPITAL.format(x="label")}, n, 60000000000 + i FROM aimed WHERE name IS NULL),
nm AS (SELECT doc_id, lower(name) AS low, arg_min(name, seq) AS name, sum(n) AS n, min(seq) AS seq FROM n2 GROUP BY doc_id, lower(name)),
ranked AS (SELECT nm.*, list_contains({_TOOLS}, low) AS known, list_contains(list_transform(hosts, lambda h: lower(string_split(h, '.')[1])), low) AS linked FROM nm JOIN hosted USING (doc_id)),
prim AS (SELECT DISTINCT ON (doc_id) doc_id, name AS prim, n AS mentions FROM ranked WHERE NOT known ORDER BY doc_id, linked DESC, n DESC, seq),
lists AS (SELECT doc_id, list(name ORDER BY seq) AS ns, coalesce(list(name ORDER BY seq) FILTER (known), []) AS fam, coalesce(list(name ORDER BY seq) FILTER (NOT known), []) AS oth FROM ranked GROUP BY doc_id)"""

PRODUCT_NAMES_SQL = f"WITH {NAMES_SQL} SELECT doc_id, prim AS primary, coalesce(mentions, 0)::INT AS mentions, coalesce(len(ns), 0)::INT AS names FROM documents LEFT JOIN prim USING (doc_id) LEFT JOIN lists USING (doc_id)"

_STRONG = r"(?i)\b(?:promo ?code|discount code|use code|referral code)\b"
_WORDS3 = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9_]+'), lambda w: length(w) > 2))"
_UNI = lambda x: f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2))"
_JAC = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
_URLS = lambda x: f"list_transform(regexp_extract_all({x}, '(?i)\\bhttps?://[^\\s<>()\"'']+'), lambda u: regexp_replace(u, '[.,;:!?)]+$', ''))"
_SELF = [P.CREATOR_NAMED, P.CREATOR_RELATIVE, P.CLEAR_CREATOR, P.CLEAR_EMPLOYMENT, P.CLEAR_AFFILIATE]
_LINK = "coalesce(link, 'https://other.example/x')"

FACTS_SQL = f"""{NAMES_SQL},
com AS (SELECT doc_id, j, CASE WHEN (doc_id + j) % 11 <> 0 THEN 'c' || (doc_id + j * j) % 3 END AS author, replace({as_sql_list(SAYINGS)}[CASE WHEN doc_id % 45 = 30 THEN 9 ELSE doc_id // 3 * 5 + j * (doc_id // 9 % 4) END % {len(SAYINGS)} + 1], 'LINK', {_LINK}) AS said, (doc_id + j) % 4 = 0 OR doc_id % 5 = 0 AS op, lower(author) AS poster FROM posts, range(0, 7) r(j) WHERE j < doc_id % 8 AND detail),
com1 AS (SELECT c.doc_id, j, c.author, said, (op OR (coalesce(poster, '') <> '' AND lower(coalesce(c.author, '')) = poster)) AS own, h.hosts, {_WORDS3("said")} AS ws FROM com c JOIN hosted h USING (doc_id)),
com2 AS (SELECT *, NOT own AND {has(P.ACCUSATION, sql_shadow("said"))} AS accuses, NOT own AND {has(P.REPEAT_MENTION, sql_shadow("said"))} AS repeats, NOT own AND {has(P.POSITIVE, sql_shadow("said"))} AND length(said) < 200 AS praises, len(list_filter({_URLS("said")}, lambda u: list_contains(hosts, {sql_host("u")}))) > 0 AS to_product, len(list_filter({_URLS("said")}, lambda u: {sql_host("u")} <> '' AND NOT ends_with({sql_host("u")}, 'reddit.com') AND list_contains(hosts, {sql_host("u")}))) > 0 AS evidence FROM com1),
alike AS (SELECT a.doc_id, count(*) FILTER (a.accuses AND b.accuses) AS accusing, count(*) FILTER (a.praises AND b.praises) AS praising FROM com2 a JOIN com2 b ON a.doc_id = b.doc_id AND a.j < b.j WHERE {_JAC("a.ws", "b.ws")} >= 0.7 GROUP BY a.doc_id),
talk AS (SELECT doc_id, count(*) FILTER (accuses) AS accusations, count(DISTINCT author) FILTER (accuses) + count(*) FILTER (accuses AND author IS NULL) AS accusers, count(*) FILTER (repeats) AS repeated, count(*) FILTER (own) AS ops, coalesce(bool_or(accuses AND {has(P.REDDIT_LINK, "said")}), FALSE) AS to_reddit, coalesce(bool_or(accuses AND evidence), FALSE) AS evident, count(*) FILTER (own AND to_product) AS op_links, coalesce({sql_shadow("string_agg(said, chr(10) ORDER BY j) FILTER (own)")}, '') AS op_text FROM com2 GROUP BY doc_id),
sub0 AS (SELECT doc_id, k, title AS own_title, CASE WHEN doc_id % 2 = 0 THEN (doc_id + k) % 3 <> 0 ELSE k = 5 END AS about, own_host, link, body0 FROM posts, range(0, 12) r(k) WHERE doc_id % 5 > 1 AND k < doc_id // 5 % 13),
sub1 AS (SELECT doc_id, k, CASE WHEN k = 2 THEN 't3_' || doc_id ELSE 'h' || k END AS id, lower('Sub' || k % (doc_id % 4 + 1)) AS place, CASE WHEN k = 3 AND doc_id % 4 = 2 THEN own_title || ' again today' WHEN k = 4 AND doc_id % 6 = 0 THEN own_title ELSE 'Weekly notes number ' || k END AS title,
  CASE WHEN about THEN own_host ELSE {as_sql_list(SITES)}[k % {len(SITES)} + 1] END AS domain, CASE WHEN about AND k % 2 = 1 THEN link END AS url, CASE WHEN k = 1 AND doc_id % 8 = 4 THEN left(body0, 400) ELSE replace({as_sql_list(ELSEWHERE)}[(doc_id + k * 2) % {len(ELSEWHERE)} + 1], 'LINK', {_LINK}) END AS excerpt FROM sub0),
sub2 AS (SELECT s.doc_id, k, place, s.title, excerpt, list_filter([lower(domain), {sql_host("url")}], lambda d: d IS NOT NULL AND d <> '') AS sites, s.title || chr(10) || excerpt AS said, t.title1, t.title AS raw_title, t.body0 FROM sub1 s JOIN trimmed t USING (doc_id) WHERE s.id <> 't3_' || s.doc_id AND lower(trim(regexp_replace(s.title, '\\s+', ' ', 'g'))) <> lower(t.title1)),
hcom AS (SELECT doc_id, k, lower('Com' || k % 3) AS place, replace({as_sql_list(ELSEWHERE)}[(doc_id * 5 + k) % {len(ELSEWHERE)} + 1], 'LINK', {_LINK}) AS said, CASE WHEN (doc_id + k) % 2 = 0 AND own_host IS NOT NULL THEN [own_host] ELSE [] END AS sites FROM posts, range(0, 7) r(k) WHERE doc_id % 5 > 1 AND k < doc_id // 7 % 8),
items AS (SELECT doc_id, 0 AS kind, k, place, said, sites, title, excerpt, raw_title, body0 FROM sub2 UNION ALL SELECT doc_id, 1, k, place, said, sites, NULL, NULL, NULL, NULL FROM hcom),
aims AS (SELECT doc_id, hosts, list_filter(coalesce(oth, []), lambda n: length(n) >= 3) AS targets FROM hosted LEFT JOIN lists USING (doc_id)),
items1 AS (SELECT i.*, len(targets) + len(hosts) > 0 AS aimed, len(list_filter(targets, lambda n: {named(sql_shadow("said"), "n")})) > 0 OR len(list_filter(hosts, lambda h: contains(lower(said), h))) > 0 OR len(list_intersect(sites, hosts)) > 0 AS about, len(list_intersect(sites, hosts)) > 0 AS linked, {_or(_SELF, sql_shadow("said"))} AS admits,
  CASE WHEN kind = 0 THEN (len({_UNI("raw_title")}) >= 5 AND {_JAC(_UNI("raw_title"), _UNI("title"))} >= 0.6) OR (len({_UNI("left(body0, 1500)")}) >= 20 AND len({_UNI("excerpt")}) >= 15 AND {_JAC(_UNI("left(body0, 1500)"), _UNI("excerpt"))} >= 0.6) END AS near FROM items i JOIN aims USING (doc_id)),
past AS (SELECT doc_id, bool_or(aimed) AS aimed, count(*) FILTER (kind = 0) AS subs, count(*) FILTER (kind = 1) AS coms, count(*) FILTER (kind = 0 AND aimed AND about) AS psubs, count(*) FILTER (kind = 1 AND aimed AND about) AS pcoms, count(*) FILTER (linked) AS linked, count(DISTINCT place) FILTER (kind = 0 AND aimed AND about) AS places, coalesce(bool_or(near AND kind = 0 AND aimed AND about), FALSE) AS near_about, coalesce(bool_or(near AND kind = 0), FALSE) AS near_any, coalesce(bool_or(aimed AND about AND admits), FALSE) AS admits FROM items1 GROUP BY doc_id),
seen AS (SELECT doc_id, count(DISTINCT d) AS sites FROM (SELECT doc_id, unnest(sites) AS d FROM sub2) WHERE NOT regexp_matches(d, 'reddit\\.com|redd\\.it') GROUP BY doc_id),
f0 AS (SELECT s.*, links, product, link_hosts, h.hosts, prim, coalesce(mentions, 0) AS mentions, coalesce(ns, []) AS ns, coalesce(fam, []) AS fam, len(list_filter(regexp_split_to_array(txt, '\\s+'), lambda w: w <> '')) AS words, {sentences("b")} AS sb, {sentences("x")} AS sx FROM shadows s JOIN hosted h USING (doc_id) JOIN texts USING (doc_id) LEFT JOIN prim USING (doc_id) LEFT JOIN lists USING (doc_id)),
f1 AS (SELECT *, len(product) > 0 AS sells, CASE WHEN prim IS NULL THEN [] ELSE list_filter(sb, lambda s: {named("s", "prim")}) END AS owns, CASE WHEN prim IS NOT NULL AND {named("b", "prim")} THEN length(regexp_extract(b, '(?is)^(.*?)\\b' || prim || '\\b', 1)) / greatest(1, length(b)) ELSE coalesce((list_min(list_filter(list_transform(product, lambda u: instr(body1, u)), lambda i: i > 0)) - 1) / greatest(1, length(body1)), -1.0) END AS enters,
  coalesce(list_max(list_transform(fam, lambda t: len(list_filter(sb, lambda s: {named("s", "t")})))), 0) AS most, {has(P.CTA)} AS cta, {has(P.DM)} AS dm, {has(P.COMMENT_INTERESTED)} AS interested, {times(P.LIMITATION, "x")} AS limits, {times(P.STEP)} AS steps, {times(P.FEATURE)} AS features, {place(P.PROBLEM, "b")} AS problem, {place(P.EMOTIONAL, "b")} AS emotion, {place(P.DISCOVERY, "b")} AS discovery, {place(P.RESOLUTION, "b")} AS resolution, {last_place(P.SUCCESS, "b")} AS success,
  left(b, (length(b) * 0.35)::INT - CASE WHEN (length(b) * 0.35)::INT > length(b) * 0.35 THEN 1 ELSE 0 END) AS head, substr(b, floor(length(b) * 0.7)::INT + 1) AS tail, substr(body1, floor(length(b) * 0.7)::INT + 1) AS tail1,
  {has(P.CREATOR_NAMED)} AS by_name, {has(P.CREATOR_RELATIVE)} AS by_relation, {has(P.CLEAR_CREATOR)} AS by_words, {has(P.CLEAR_CREATOR, f"regexp_replace(x, {quote(P.GENERIC_POSSESSIVE)}, ' ', 'g')")} AS by_more, {has(P.CLEAR_EMPLOYMENT)} AS employed, {has(P.CLEAR_BENEFIT)} AS benefits, {has(P.CLEAR_AFFILIATE)} AS earns, {has(P.UNCLEAR_WORKING_ON)} AS works, {has(P.UNCLEAR_INVOLVED)} AS involved, {has(P.FRIENDS_PRODUCT)} AS friends FROM f0),
f2 AS (SELECT *, enters >= 0 OR sells AS there, CASE WHEN by_name THEN 1 WHEN by_relation THEN 2 WHEN by_words AND (prim IS NOT NULL OR sells OR by_more) THEN 3 ELSE 0 END AS maker FROM f1),
f3 AS (SELECT *, there OR dm OR interested OR cta AS offers, maker > 0 OR employed OR benefits OR earns AS says,
  list_max([CASE maker WHEN 1 THEN {place(P.CREATOR_NAMED, "x")} WHEN 2 THEN {place(P.CREATOR_RELATIVE, "x")} WHEN 3 THEN {place(P.CLEAR_CREATOR, "x")} ELSE -1.0 END, CASE WHEN employed THEN {place(P.CLEAR_EMPLOYMENT, "x")} ELSE -1.0 END, CASE WHEN benefits THEN {place(P.CLEAR_BENEFIT, "x")} ELSE -1.0 END, CASE WHEN earns THEN {place(P.CLEAR_AFFILIATE, "x")} ELSE -1.0 END]) AS latest FROM f2),
facts AS (SELECT f.*, says OR brand AS clear, coalesce(accusations, 0) AS accusations, coalesce(accusers, 0) AS accusers, coalesce(accusations, 0) >= 2 AND coalesce(accusing, 0) >= 1 AS copied, coalesce(praising, 0) AS praising, coalesce(repeated, 0) AS repeated, coalesce(ops, 0) AS ops, coalesce(to_reddit, FALSE) AS to_reddit, coalesce(evident, FALSE) AS evident, coalesce(op_links, 0) AS op_links, coalesce(op_text, '') AS op_text,
  doc_id % 5 > 1 AS known, len(targets) + len(f.hosts) > 0 AS aimed, coalesce(subs, 0) AS subs, coalesce(coms, 0) AS coms, coalesce(psubs, 0) AS psubs, coalesce(pcoms, 0) AS pcoms, coalesce(linked, 0) AS linked, coalesce(places, 0) AS places, CASE WHEN coalesce(psubs, 0) > 0 THEN near_about ELSE coalesce(near_any, FALSE) END AS near, coalesce(admits, FALSE) AS admits, coalesce(sites, 0) AS sites, CASE WHEN doc_id % 9 <> 0 THEN CASE WHEN doc_id % 7 = 2 THEN doc_id % 40 ELSE doc_id * 37 % 2000 END END AS days, CASE WHEN doc_id % 10 <> 3 THEN doc_id * 3 % 80 END AS link_karma, doc_id % 40 AS karma
  FROM f3 f LEFT JOIN talk USING (doc_id) LEFT JOIN alike USING (doc_id) LEFT JOIN past USING (doc_id) LEFT JOIN seen USING (doc_id) LEFT JOIN aims USING (doc_id))"""

_TRACKED = f"len(list_filter(product, lambda u: {has(P.AFFILIATE_PARAM, 'u')} OR {has(P.AFFILIATE_PATH, 'u')} OR (ends_with({sql_host('u')}, 'amazon.com') AND regexp_matches(u, '[?&]tag=')))) > 0"
_REDIRECTS = f"len(list_filter(link_hosts, lambda h: len(list_filter({as_sql_list(P.REDIRECT_HOSTS)}, lambda r: h = r OR ends_with(h, '.' || r))) > 0)) > 0"
_SHARE = "CASE WHEN subs > 0 THEN psubs / subs ELSE 0.0 END"
_START = "CASE WHEN problem < 0 THEN emotion WHEN emotion < 0 THEN problem ELSE least(problem, emotion) END"
_BARE = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
_TRIES = f"list_filter(list_transform(list_concat(CASE WHEN prim IS NULL THEN []::VARCHAR[] ELSE [prim] END, list_transform(hosts, lambda h: string_split(h, '.')[1])), lambda n: {_BARE('n')}), lambda n: length(n) >= 4)"
_AUTHOR = _BARE("coalesce(author, '')")
_ADMITS = f"(ops > 0 AND {_or([P.CLEAR_CREATOR, P.CLEAR_EMPLOYMENT, P.CLEAR_AFFILIATE, P.CLEAR_BENEFIT], 'op_text')})"
_HIST = "known AND aimed AND subs + coms > 0"
_UNLIKE = f"len(list_filter(sx, lambda s: {has(P.COMPARE, 's')} AND len(list_filter(ns, lambda n: {named('s', 'n')})) >= 2)) > 0"

#: (id, condition, weight where it is not the criterion's, verified where it isn't the criterion's), in the engine's order.
DIRECT = [
    ("cta.direct", "cta", None, None),
    ("cta.coupon", f"({has(P.COUPON)} OR {has(P.CODE_TOKEN)})", f"CASE WHEN {has(_STRONG)} THEN 25 ELSE 20 END", None),
    ("cta.signup-benefit", has(P.SIGNUP_BENEFIT), None, None),
    ("cta.waitlist", has(P.WAITLIST), None, None),
    ("cta.comment-interested", "interested", None, None),
    ("cta.dm-request", "dm", f"CASE WHEN {has(P.DM_FOR)} THEN 20 ELSE 15 END", None),
    ("cta.feedback-redirect", f"({has(P.FEEDBACK)} AND sells AND cta)", None, None),
    ("cta.repeated-links", "len(link_hosts) > len(list_distinct(link_hosts))", None, None),
]
LINKS = [
    ("link.affiliate-params", _TRACKED, None, None),
    ("link.redirect-tracking", _REDIRECTS, None, None),
    ("link.product-link", "len(hosts) > 0", None, None),
    ("workflow.only-product-linked", "len(fam) + (prim IS NOT NULL)::INT >= 3 AND len(hosts) = 1 AND prim IS NOT NULL AND lower(string_split(hosts[1], '.')[1]) = lower(prim)", None, None),
]
WORKFLOW = [
    ("workflow.obscure-among-familiar", "prim IS NOT NULL AND steps >= 2 AND len(fam) >= 1", None, None),
    ("workflow.necessary-step", f"prim IS NOT NULL AND steps >= 2 AND len(list_filter(owns, lambda s: {has(P.NECESSARY, 's')})) > 0", None, None),
    ("workflow.success-attributed", f"prim IS NOT NULL AND len(list_filter(owns, lambda s: {has(P.ATTRIBUTION, 's')})) > 0", None, None),
    ("workflow.more-detail", "prim IS NOT NULL AND len(fam) >= 1 AND len(owns) >= 3 AND len(owns) >= greatest(3, most * 2)", None, None),
]
NARRATIVE = [
    ("story.problem-product-success", f"offers AND words >= 40 AND ({_START}) >= 0 AND greatest(discovery, enters) > ({_START}) AND greatest(success, resolution) > ({_START})", None, None),
    ("story.emotional-intro", f"offers AND words >= 40 AND enters > 0.3 AND {has(P.EMOTIONAL, 'head')}", None, None),
    ("story.advice-then-product", f"{has(P.ADVICE_TITLE, 't')} AND words >= 80 AND (len(list_intersect({_URLS('tail1')}, product)) > 0 OR {has(P.CTA, 'tail')} OR {has(P.DM, 'tail')})", None, None),
    ("story.result-title-tool-body", f"{has(P.RESULT_TITLE, 't')} AND (sells OR {has(P.CTA, 'b')})", None, None),
    ("story.solves-everything", f"there AND {has(P.SOLVES_ALL, 'b')} AND {times(P.PROBLEM)} >= 2", None, None),
    ("story.no-limitations", "offers AND words >= 80 AND limits = 0", None, None),
    ("story.few-details", "sells AND words < 60 AND NOT regexp_matches(body1, '[0-9]')", None, None),
    ("lang.seo-name-repetition", "mentions >= 6 AND mentions >= words // 60 + 2", None, None),
    ("story.name-repeated", "mentions >= 4 AND mentions < 6 AND mentions >= words // 60 + 2", None, None),
    ("story.testimonial", has(P.TESTIMONIAL), None, None),
    ("story.dramatic-claims", f"offers AND {has(P.DRAMATIC)}", None, None),
]
LANGUAGE = [
    ("lang.hype-phrases", has(P.HYPE), None, None),
    ("lang.transformation", has(P.TRANSFORM), None, None),
    ("lang.feature-focus", "features >= 5 AND words >= 60", None, None),
    ("lang.sales-page-format", f"features >= 2 AND {times(P.BULLET)} >= 3", None, None),
    ("lang.slogans", has(P.SLOGAN), None, None),
    ("lang.unsupported-performance", has(P.PERFORMANCE), None, None),
    ("lang.pricing-details", has(P.PRICING, "b"), None, None),
    ("lang.search-title", f"{has(P.SEARCH_TITLE, 't')} AND (prim IS NOT NULL OR sells)", None, None),
]
DISCLOSURE = [
    ("disclosure.creator", "maker > 0", None, None),
    ("disclosure.employment", "employed", None, None),
    ("disclosure.material-benefit", "benefits", None, None),
    ("disclosure.affiliate", "earns", None, None),
    ("disclosure.brand-affiliate-label", "brand", None, None),
    ("disclosure.buried", "says AND ((words > 150 AND latest > 0.85) OR (words > 300 AND latest > 0.5))", None, None),
    ("disclosure.unclear-working-on", "NOT clear AND works", None, None),
    ("disclosure.unclear-involved", "NOT clear AND involved", None, None),
    ("disclosure.friends-product", "NOT clear AND friends", None, None),
]
ACCOUNT = [("account.username-matches", f"length({_AUTHOR}) >= 4 AND len(list_filter({_TRIES}, lambda n: contains({_AUTHOR}, n) OR contains(n, {_AUTHOR}))) > 0", None, None)]
COMMENTS = [
    ("community.coordinated-accusations", "copied", None, None),
    ("community.several-independent-concerns", "NOT copied AND accusers >= 2", None, None),
    ("community.single-accusation", "NOT copied AND accusers < 2 AND accusations = 1", None, None),
    ("community.repeated-posts-identified", "NOT copied AND repeated > 0", None, "FALSE"),
    ("community.linked-identical-post", "NOT copied AND to_reddit", None, "FALSE"),
    ("community.author-product-evidence", "NOT copied AND evident", None, "FALSE"),
    ("community.author-admission", _ADMITS, None, None),
    ("behavior.dm-for-link", f"ops > 0 AND {has(P.DM, 'op_text')}", None, None),
    ("behavior.comment-interested-dm", f"ops > 0 AND {has(P.COMMENT_INTERESTED, 'op_text')}", None, None),
    ("behavior.private-group", f"ops > 0 AND {times(P.PRIVATE_GROUP, 'op_text')} >= 2", None, None),
    ("behavior.same-product-replies", "op_links >= 3", None, None),
    ("counter.answers-without-push", f"ops >= 3 AND NOT ({has(P.DM, 'op_text')} OR {has(P.CTA, 'op_text')} OR op_links > 0)", None, None),
    ("coord.similar-wording", "praising >= 2", None, None),
    ("community.mod-removed", "detail AND regexp_matches(b, '(?i)\\[removed\\]|removed by (?:the )?moderators?') AND regexp_matches(b, '(?i)self[- ]?promo|spam|advertis')", None, None),
]
_COMMERCIAL = "(" + " OR ".join(f"({c})" for _, c, _, _ in [*DIRECT, *[x for x in LINKS if x[0] != "link.product-link"]]) + " OR sells)"
COUNTER = [
    ("counter.limitations", "limits >= 1", "CASE WHEN limits >= 2 THEN -15 ELSE -10 END", None),
    ("counter.compares-alternatives", f"len(ns) >= 3 AND {_UNLIKE}", None, None),
    ("counter.useful-no-links", "len(links) = 0 AND words >= 120", None, None),
    ("counter.discourages-buyers", has(P.DISCOURAGE), None, None),
    ("counter.no-cta", f"NOT {_COMMERCIAL}", None, None),
]
HISTORY = [
    ("availability.profile-history-unavailable", "doc_id % 5 <= 1", None, None),
    ("availability.profile-history-checked", "known", None, None),
    ("account.repeats-domain", f"{_HIST} AND linked >= 2", "CASE WHEN linked >= 4 THEN 25 ELSE 15 END", None),
    ("history.cross-subreddit", f"{_HIST} AND psubs >= 2 AND places >= 3", None, None),
    ("account.single-product-history", f"{_HIST} AND subs >= 3 AND {_SHARE} >= 0.5", None, None),
    ("history.repeated-text", f"{_HIST} AND near", None, None),
    ("account.comments-redirect", f"{_HIST} AND pcoms >= 3 AND pcoms / greatest(1, coms) >= 0.4", None, None),
    ("account.self-identified-elsewhere", f"{_HIST} AND admits", None, "TRUE"),
    ("account.new-account", "known AND days < 30", None, None),
    ("account.low-karma", "known AND link_karma + karma < 50", None, None),
    ("account.new-low-karma-product-focus", f"known AND days < 30 AND coalesce(link_karma, 0) + karma < 50 AND {_SHARE} >= 0.5 AND subs >= 2", None, None),
    ("counter.varied-recommendations", f"known AND aimed AND subs >= 5 AND sites >= 3 AND {_SHARE} < 0.3", None, None),
    ("counter.genuine-history", "known AND subs + coms >= 10 AND (psubs + pcoms) / greatest(1, subs + coms) <= 0.1 AND (days IS NULL OR days >= 365)", None, None),
    ("counter.incidental-product", "known AND aimed AND subs + coms >= 8 AND psubs + pcoms <= 1", None, None),
]
_ANY = lambda kinds: "(" + " OR ".join(f"({c})" for kind in kinds for _, c, _, _ in kind) + ")"
LAST = [
    ("workflow.no-relationship-disclosed", f"prim IS NOT NULL AND {_ANY([WORKFLOW, LINKS, DIRECT])} AND NOT (clear OR works OR involved OR friends) AND NOT {_ADMITS}", None, None),
    ("disclosure.comments-only", f"{_ADMITS} AND NOT clear", None, None),
    ("reach.upvotes", "TRUE", None, None),
    ("reach.comments", "comments IS NOT NULL", None, None),
    ("availability.comments-unavailable", "NOT detail", None, None),
    ("availability.body-truncated", "NOT detail AND length(body0) > 0", None, None),
]
SIGNALS = [*DIRECT, *LINKS, *WORKFLOW, *NARRATIVE, *LANGUAGE, *DISCLOSURE, *ACCOUNT, *COMMENTS, *COUNTER, *HISTORY, *LAST]


def signals_sql(criteria: str) -> str:
    """The table sig of every post's signals, for the catalogue crit that criteria gives."""
    rows = ", ".join(f"CASE WHEN {c} THEN {{'j': {j}, 'id': {quote(i)}, 'w': ({w or 'NULL'})::DOUBLE, 'v': ({v or 'NULL'})::BOOLEAN}} END" for j, (i, c, w, v) in enumerate(SIGNALS))
    return f"""WITH {FACTS_SQL}, {criteria},
hits AS (SELECT doc_id, detail, unnest([{rows}]) AS hit FROM facts),
sig AS (SELECT doc_id, detail, hit.j AS j, c.* EXCLUDE (weight), coalesce(hit.w, c.weight) AS weight, coalesce(hit.v, NOT c.verify) AS verified FROM hits JOIN crit c ON c.id = hit.id WHERE hit IS NOT NULL)
"""


__all__ = ["AS_OF", "PRODUCT_NAMES_SQL", "SIGNALS", "signals_sql"]
