"""Queries over identity stitching and its audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditweave.functions import events
from auditweave.operators import identity, ordered, purity
from auditweave.plans.adapter import EV, audit_events
from auditweave.plans.registry import query

# Federation keys on some events, and no user agents: only keys and principals stitch.
_FED = "CASE WHEN k % 7 = 0 THEN concat('fed_', user_no % 40) END"
FED_EV = f"""{EV}, fe AS (SELECT *, {_FED.replace('user_no', 'user_id')} AS fed FROM ev),
  nodes AS (SELECT *, coalesce(last_value(fed IGNORE NULLS) OVER (PARTITION BY principal
    ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), principal) AS node FROM fe),
  st AS (SELECT *, first_value(event_id) OVER (PARTITION BY node ORDER BY t, event_id) AS founder,
    CASE WHEN fed IS NOT NULL THEN 'federation'
      WHEN row_number() OVER (PARTITION BY node ORDER BY t, event_id) = 1 THEN 'new_entity'
      ELSE 'fast_path' END AS method FROM nodes)"""


def federated(spark: SparkSession, sf_dir: str) -> identity.Resolution:
    ev = audit_events(spark, sf_dir).withColumns(
        {"federation_id": F.expr(_FED), "ua_family": F.lit("Other"), "ua_version": F.lit("Unknown"),
         "gt_principal": F.col("principal")}
    )
    return identity.resolve_entities(ev)


def _with_founder(stitched: DataFrame) -> DataFrame:
    founders = stitched.where("is_new").select(
        F.col("entity_id").alias("__e"), F.col("event_id").alias("founder")
    )
    return stitched.join(founders, F.col("entity_id") == F.col("__e"))


@query(
    "federation_stitching",
    f"WITH {FED_EV} SELECT event_id, founder, method, event_id = founder AS is_new FROM st",
)
def federation_stitching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_founder(federated(spark, sf_dir).events).select(
        "event_id", "founder", "method", "is_new"
    )


# One identity per user and day; sign-ups create the neighbour's identity of tomorrow.
_DAY = "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))"
PROV_EV = f"""{EV}, pe AS (SELECT event_id, t, concat('u', user_id, '_', {_DAY}) AS principal,
    CASE WHEN action = 'CreateUser' THEN concat('u', user_id + 1, '_', {_DAY} + 1) END AS created FROM ev),
  firsts AS (SELECT principal, min(t) AS t0, arg_min(event_id, t) AS e0 FROM pe GROUP BY 1),
  links AS (SELECT f.principal AS child, arg_max(c.principal, c.t) AS parent FROM firsts f
    JOIN pe c ON c.created = f.principal AND c.t < f.t0 GROUP BY 1),
  up AS (WITH RECURSIVE walk AS (SELECT principal, principal AS root FROM firsts
      UNION ALL SELECT w.principal, l.parent FROM walk w JOIN links l ON l.child = w.root)
    SELECT principal, root FROM walk WHERE root NOT IN (SELECT child FROM links))"""


def provenanced(spark: SparkSession, sf_dir: str) -> identity.Resolution:
    ev = audit_events(spark, sf_dir)
    day = F.datediff("timestamp", F.lit("2024-01-01").cast("date"))
    name = F.concat(F.lit("u"), "user_no", F.lit("_"), day)
    made = F.concat(F.lit("u"), F.col("user_no") + 1, F.lit("_"), day + 1)
    ev = ev.withColumns(
        {
            "principal": name,
            "created_principal_name": F.when(F.col("action") == "CreateUser", made),
            "ua_family": F.lit("Other"), "ua_version": F.lit("Unknown"),
        }
    )
    return identity.resolve_entities(ev)


@query(
    "creation_provenance",
    f"""WITH {PROV_EV}
    SELECT pe.event_id, r.e0 AS founder,
      CASE WHEN pe.event_id <> f.e0 THEN 'fast_path'
        WHEN up.root = pe.principal THEN 'new_entity' ELSE 'provenance' END AS method
    FROM pe JOIN up USING (principal) JOIN firsts f USING (principal)
      JOIN firsts r ON r.principal = up.root""",
)
def creation_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_founder(provenanced(spark, sf_dir).events).select("event_id", "founder", "method")


@query(
    "known_principals",
    f"""WITH {EV} SELECT principal, count(*) AS n_events, count(*) - 1 AS n_fast_path,
      1 AS n_entities FROM ev GROUP BY 1""",
)
def known_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = audit_events(spark, sf_dir).withColumn("ua_family", F.lit("Other"))
    out = identity.resolve_entities(ev).events
    return out.groupBy("principal").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("method") == "fast_path").alias("n_fast_path"),
        F.count_distinct("entity_id").alias("n_entities"),
    )


# ------------------------------------------------------------------ similarity

_PAIR = """(PARTITION BY home_cloud ORDER BY t, event_id)"""
_TOOLS = "('aws-cli', 'Boto3', 'aws-sdk-go', 'Terraform', 'azure-cli', 'google-cloud-sdk', 'pulumi')"
_KIND = """CASE WHEN {0} IN ('ServiceAccount', 'AssumedRole') THEN 'automation'
  WHEN {0} IN ('IAMUser', 'User') THEN 'human' END"""
_SIM = f"""pairs AS (SELECT event_id, ua_family AS fa, ua_version AS va, is_known_proxy_or_tor AS xa,
    {_KIND.format('principal_type')} AS ka, source_ip AS ia,
    lag(ua_family) OVER {_PAIR} AS fb, lag(ua_version) OVER {_PAIR} AS vb,
    lag(is_known_proxy_or_tor) OVER {_PAIR} AS xb, lag(source_ip) OVER {_PAIR} AS ib,
    lag({_KIND.format('principal_type')}) OVER {_PAIR} AS kb FROM ev),
  sims AS (SELECT event_id,
    CASE WHEN fa = fb AND fa NOT IN ('Unknown', 'Other')
      THEN 0.315 + CASE WHEN va = vb AND va NOT IN ('Unknown', 'Other') THEN 0.135 ELSE 0 END
      WHEN fa IN {_TOOLS} AND fb IN {_TOOLS} THEN 0.09 ELSE 0 END AS ua,
    CASE WHEN xa AND xb THEN 0.25 ELSE 0 END AS proxy,
    CASE WHEN NOT xa AND NOT xb AND ia = ib THEN 0.10 ELSE 0 END AS ip,
    CASE WHEN ka = kb THEN 0.20 ELSE 0 END AS type FROM pairs WHERE fb IS NOT NULL)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes a_* of each event and b_* of the one before; clouds are sliced when hot."""
    ev = audit_events(spark, sf_dir)
    own = ev.select(
        "event_id", "home_cloud", events.micros(F.col("timestamp")).alias("t"),
        *[c.alias(f"a_{n}") for n, c in identity.attributes(ev).items()],
    )
    attributes = F.struct(*[F.col(f"a_{n}").alias(n) for n in identity.ATTRIBUTES])
    before = ordered.running(
        ordered.with_slices(own, ["home_cloud"], "t"), "t", ["event_id"],
        {"b": ordered.latest(attributes)}, exclusive=True,
    ).plain()
    return before.where(F.col("b").isNotNull()).select(
        "*", *[F.col(f"b.{n}").alias(f"b_{n}") for n in identity.ATTRIBUTES]
    )


@query(
    "similarity_breakdown",
    f"""WITH {EV}, {_SIM}
    SELECT event_id, CAST(ua AS DOUBLE) AS ua, CAST(proxy AS DOUBLE) AS proxy, CAST(ip AS DOUBLE) AS ip,
      CAST(type AS DOUBLE) AS type, CAST(ua + proxy + ip + type AS DOUBLE) AS total FROM sims""",
)
def similarity_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event against the one before it in the same home cloud."""
    pairs = _pairs(spark, sf_dir)
    parts = identity.similarity_breakdown(identity.side("a_"), identity.side("b_"))
    return pairs.select("event_id", parts.alias("p")).select("event_id", "p.*")


@query(
    "similarity_score",
    f"""WITH {EV}, {_SIM}
    SELECT round(CAST(ua + proxy + ip + type AS DOUBLE), 4) AS score, count(*) AS n FROM sims GROUP BY 1""",
)
def similarity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    score = identity.similarity(identity.side("a_"), identity.side("b_"))
    return pairs.groupBy(score.alias("score")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- fuzzy stage

def daily_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short-lived identities, so that the fuzzy stage has decisions to take."""
    ev = audit_events(spark, sf_dir)
    day = F.datediff("timestamp", F.lit("2024-01-01").cast("date"))
    return ev.withColumns(
        {
            "gt_principal": F.col("principal"),
            "principal": F.concat("principal", F.lit("_"), day),
        }
    )


# SQL: identity by identity inside a family, in the order of their first events. ``active`` lists the
# earlier identities seen in the lookback, ``scores`` the likeness to every earlier one, and
# ``owners`` grows by one decision a step.
_LIKENESS = """CASE WHEN {a}.ua_family = {b}.ua_family THEN 0.315e0 + CASE WHEN {a}.ua_version = {b}.ua_version
      AND {a}.ua_version NOT IN ('Unknown', 'Other', '') THEN 0.135e0 ELSE 0e0 END ELSE 0e0 END AS ua,
    CASE WHEN {a}.proxy AND {b}.proxy THEN 0.25e0 ELSE 0e0 END AS proxy,
    CASE WHEN NOT {a}.proxy AND NOT {b}.proxy AND {a}.source_ip = {b}.source_ip THEN 0.1e0 ELSE 0e0 END AS ip,
    CASE WHEN {a}.kind = {b}.kind THEN 0.2e0 ELSE 0e0 END AS type"""
FUZZY = f"""WITH RECURSIVE {EV}, de AS (SELECT event_id, t, principal AS actor, concat(principal, '_', {_DAY}) AS node,
    ua_family, ua_version, is_known_proxy_or_tor AS proxy, {_KIND.format('principal_type')} AS kind, source_ip FROM ev),
  firsts AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ua_family ORDER BY t, event_id) AS i FROM (
    SELECT * FROM de QUALIFY row_number() OVER (PARTITION BY node ORDER BY t, event_id) = 1)),
  seen AS (SELECT f.ua_family, f.i, list(DISTINCT m.i) AS active
    FROM firsts f JOIN firsts m ON m.ua_family = f.ua_family AND m.i < f.i JOIN de e ON e.node = m.node
      AND e.t >= f.t - 10800000000 AND (e.t, e.event_id) < (f.t, f.event_id) GROUP BY 1, 2),
  likeness AS (SELECT f.ua_family, f.i, m.i AS j, {_LIKENESS.format(a='f', b='m')}
    FROM firsts f JOIN firsts m ON m.ua_family = f.ua_family AND m.i < f.i),
  steps AS MATERIALIZED (SELECT firsts.ua_family, firsts.i, coalesce(active, []) AS active, scores FROM firsts
    LEFT JOIN seen USING (ua_family, i) LEFT JOIN (SELECT ua_family, i, list(round(ua + proxy + ip + type, 4) ORDER BY j) AS scores
      FROM likeness GROUP BY 1, 2) USING (ua_family, i) WHERE firsts.ua_family NOT IN ('Unknown', 'Other', '')),
  walk AS (SELECT ua_family, i, [i] AS owners, CAST(NULL AS DOUBLE) AS best, 'new_entity' AS method FROM steps WHERE i = 1
    UNION ALL
    SELECT ua_family, i, list_append(owners, CASE WHEN method = 'fuzzy_merge' THEN list_filter(options, lambda j: scores[j] = best)[1] ELSE i END),
      best, method FROM (
        SELECT *, ranked[1] AS best, CASE WHEN len(ranked) = 0 THEN 'new_entity' WHEN ranked[1] - ranked[2] < 0.05e0
          THEN 'new_entity_ambiguous' ELSE 'fuzzy_merge' END AS method FROM (
            SELECT *, list_reverse_sort(list_transform(options, lambda j: scores[j])) AS ranked FROM (
              SELECT s.ua_family, s.i, s.scores, w.owners, list_filter(list_distinct(list_transform(s.active, lambda m: w.owners[m])),
                lambda j: s.scores[j] >= 0.65e0) AS options
              FROM walk w JOIN steps s ON s.ua_family = w.ua_family AND s.i = w.i + 1)))),
  decided AS (SELECT f.node, f.event_id AS first_id, coalesce(w.method, 'new_entity') AS method, w.best,
      coalesce(w.owners[f.i], f.i) AS owner, f.ua_family FROM firsts f LEFT JOIN walk w ON w.ua_family = f.ua_family AND w.i = f.i),
  named AS (SELECT d.*, 'entity_' || substr(sha256(o.node || '|' || o.t || '|' || o.event_id), 1, 32) AS entity_id,
      o.ua_version, o.proxy, o.kind, o.source_ip
    FROM decided d JOIN firsts o ON o.ua_family = d.ua_family AND o.i = d.owner),
  fz AS (SELECT de.event_id, de.t, n.entity_id, de.actor, CASE WHEN de.event_id = n.first_id THEN n.method ELSE 'fast_path' END AS method,
      CASE WHEN de.event_id = n.first_id THEN n.best END AS similarity FROM de JOIN named n USING (node)),
  wrong AS (SELECT z.event_id, z.entity_id, z.actor AS merged_actor, z.similarity, p.* EXCLUDE (event_id) FROM (
      SELECT *, row_number() OVER (PARTITION BY entity_id, actor ORDER BY t, event_id) AS nth FROM fz) z
    JOIN (SELECT de.event_id, {_LIKENESS.format(a='de', b='n')} FROM de JOIN named n USING (node)) p USING (event_id)
    WHERE z.method = 'fuzzy_merge' AND z.nth = 1)"""


@query(
    "fuzzy_stitching",
    f"""{FUZZY} SELECT event_id, entity_id, method, method LIKE 'new_entity%' AS is_new, similarity FROM fz""",
)
def fuzzy_stitching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.resolve_entities(daily_identities(spark, sf_dir)).events.select(
        "event_id", "entity_id", "method", "is_new", "similarity"
    )


@query(
    "fuzzy_wrong_merges",
    f"""{FUZZY} SELECT event_id, entity_id, merged_actor, similarity, round(ua, 4) AS ua, round(proxy, 4) AS proxy,
      round(ip, 4) AS ip, round(type, 4) AS type, round(ua + proxy + ip + type, 4) AS total FROM wrong""",
)
def fuzzy_wrong_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = identity.resolve_entities(daily_identities(spark, sf_dir))
    return purity.wrong_merges(resolved)


@query(
    "fuzzy_signal_blame",
    f"""{FUZZY} SELECT count(*) AS wrong_merges, round(coalesce(sum(ua), 0), 3) AS ua, round(coalesce(sum(proxy), 0), 3) AS proxy,
      round(coalesce(sum(ip), 0), 3) AS ip, round(coalesce(sum(type), 0), 3) AS type FROM wrong""",
)
def fuzzy_signal_blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = identity.resolve_entities(daily_identities(spark, sf_dir))
    return purity.signal_blame(purity.wrong_merges(resolved))


# ---------------------------------------------------------------------- audits

@query(
    "merge_audit",
    f"""WITH {FED_EV}, joins AS (SELECT node, key, min(t) AS t, arg_min(event_id, t) AS event_id
      FROM (SELECT node, t, event_id, unnest([principal, fed]) AS key FROM st) WHERE key IS NOT NULL
      GROUP BY 1, 2),
    news AS (SELECT node, event_id, count(*) AS n FROM joins GROUP BY 1, 2)
    SELECT st.event_id, CASE method WHEN 'federation' THEN '1-federation' WHEN 'new_entity' THEN 'new'
        ELSE method END AS tier, method, principal AS event_principal,
      CAST(sum(coalesce(news.n, 0)) OVER (PARTITION BY st.node ORDER BY st.t, st.event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS n_keys_so_far
    FROM st LEFT JOIN news ON news.node = st.node AND news.event_id = st.event_id""",
)
def merge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.merge_audit(federated(spark, sf_dir).events).select(
        "event_id", "tier", "method", "event_principal", "n_keys_so_far"
    )


@query(
    "entity_members",
    f"""WITH {FED_EV} SELECT min(founder) AS founder, key, min(t) AS joined_us, arg_min(event_id, struct_pack(t := t, e := event_id)) AS joined_id
      FROM (SELECT node, founder, t, event_id, unnest([principal, fed]) AS key FROM st) WHERE key IS NOT NULL GROUP BY node, key""",
)
def entity_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of each entity with the event by which they joined."""
    stitched = federated(spark, sf_dir).events
    founders = stitched.where("is_new").select("entity_id", F.col("event_id").alias("founder"))
    return identity.entity_members(stitched).join(founders, "entity_id").drop("entity_id")


@query(
    "entity_statistics",
    f"""WITH {FED_EV} SELECT min(founder) AS founder, count(*) AS n_events,
      count(DISTINCT principal) AS n_principals, count(DISTINCT source_cloud) AS n_clouds,
      max(t) AS last_seen_us,
      count(*) FILTER (WHERE t >= (SELECT max(t) FROM ev) - 60000000) AS window_size
    FROM st GROUP BY node""",
)
def entity_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stitched = federated(spark, sf_dir).events
    founders = stitched.where("is_new").select("entity_id", F.col("event_id").alias("founder"))
    return identity.entity_stats(stitched).join(founders, "entity_id").drop("entity_id")


@query(
    "purge_idle_entities",
    f"""WITH {FED_EV}, e AS (SELECT node, min(founder) AS founder, max(t) AS seen FROM st GROUP BY 1)
    SELECT founder FROM e WHERE seen < (SELECT max(t) FROM ev) - 86400000000""",
)
def purge_idle_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = federated(spark, sf_dir)
    state = identity.next_state(resolved)
    now = resolved.events.agg(F.max(events.micros(F.col("timestamp")))).first()[0]
    _, purged = identity.purge(state, now, 86_400)
    founders = resolved.events.where("is_new").select("entity_id", F.col("event_id").alias("founder"))
    return purged.join(founders, "entity_id").select("founder")


@query(
    "identity_state_summary",
    f"""WITH {FED_EV} SELECT (SELECT count(DISTINCT node) FROM st) AS known_entities,
      (SELECT count(DISTINCT node) FROM st WHERE t >= (SELECT max(t) FROM ev) - 60000000)
        AS entities_with_active_window,
      (SELECT count(*) FROM (SELECT principal FROM st UNION SELECT fed FROM st WHERE fed IS NOT NULL))
        AS tracked_identity_keys,
      0 AS tracked_provenance_records""",
)
def identity_state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = federated(spark, sf_dir)
    now = resolved.events.agg(F.max(events.micros(F.col("timestamp")))).first()[0]
    return identity.state_summary(identity.next_state(resolved), now)


@query(
    "entity_purity",
    f"""WITH {FED_EV}, e AS (SELECT min(founder) AS founder, count(*) AS n_events,
        count(DISTINCT principal) AS n_distinct_gt_principals,
        count(*) FILTER (WHERE is_attack = 1) AS n_attack_events,
        count(*) FILTER (WHERE is_attack = 0) AS n_benign_events,
        count(DISTINCT source_cloud) AS n_clouds FROM st GROUP BY node)
    SELECT *, CASE WHEN n_distinct_gt_principals <= 1 THEN 'pure'
      WHEN n_attack_events > 0 AND n_benign_events > 0 THEN 'mixed-label'
      ELSE 'mixed-principal' END AS purity FROM e""",
)
def entity_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    stitched = federated(spark, sf_dir).events
    founders = stitched.where("is_new").select("entity_id", F.col("event_id").alias("founder"))
    table = purity.worst_first(purity.entity_purity(stitched).join(founders, "entity_id"))
    return table.drop("entity_id")


@query(
    "resolution_methods",
    f"WITH {FED_EV} SELECT method, count(*) AS n FROM st GROUP BY 1",
)
def resolution_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purity.method_counts(federated(spark, sf_dir).events)


@query(
    "oracle_stitching",
    f"""WITH {EV}, o AS (SELECT *, home_cloud || '/' || (user_id // 3) AS actor FROM ev)
    SELECT event_id, first_value(event_id) OVER (PARTITION BY coalesce(actor, principal)
      ORDER BY t, event_id) AS founder FROM o""",
)
def oracle_stitching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground-truth actors as federation keys."""
    from auditweave.operators import evaluate

    ev = audit_events(spark, sf_dir)
    actor = F.concat("home_cloud", F.lit("/"), F.floor(F.col("user_no") / 3).cast("long"))
    keyed = evaluate._oracle_keys(ev.withColumn("gt_principal", actor))
    return _with_founder(identity.resolve_entities(keyed).events).select("event_id", "founder")


@query(
    "warmup_then_scoring",
    f"""WITH {EV}, half AS (SELECT *, t < 1705276800000000 AS warm FROM ev)
    SELECT event_id, first_value(event_id) OVER (PARTITION BY principal ORDER BY t, event_id) AS founder,
      array_to_string(list_sort(list_distinct(list(source_cloud) OVER (PARTITION BY principal
        ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))), ',') AS clouds, warm
    FROM half QUALIFY NOT warm""",
)
def warmup_then_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities and footprints learned on one half carry over to the other."""
    from auditweave.operators import risk

    ev = audit_events(spark, sf_dir).withColumn("ua_family", F.lit("Other"))
    middle = F.lit("2024-01-15").cast("timestamp")
    learned = identity.resolve_entities(ev.where(F.col("timestamp") < middle))
    state = identity.next_state(learned)
    later = identity.resolve_entities(ev.where(F.col("timestamp") >= middle), state)
    traced = risk.lifetime_clouds(later.events, prior=state.clouds)
    founders = learned.events.where("is_new").unionByName(later.events.where("is_new")).select(
        "entity_id", F.col("event_id").alias("founder")
    )
    return traced.join(founders, "entity_id").select(
        "event_id", "founder", F.array_join("lifetime_clouds", ",").alias("clouds"),
        F.lit(False).alias("warm"),
    )
