"""Stitching against an event-by-event replay written independently for the tests."""

import random

import pytest
from helpers import at, by, rows
from pyspark.sql import functions as F

from auditweave.operators import identity, purity, segments
from auditweave.plans.stitching import daily_identities

SCHEMA = (
    "event_id int, timestamp timestamp, principal string, source_cloud string, ua_family string, "
    "ua_version string, source_ip string, principal_type string, is_known_proxy_or_tor boolean, "
    "federation_id string, created_principal_name string"
)


def event(i, seconds, principal, cloud="AWS", ua=("curl", "8"), ip="1.1.1.1", kind="IAMUser", proxy=False,
          fed=None, made=None):
    return (i, at(seconds), principal, cloud, ua[0], ua[1], ip, kind, proxy, fed, made)


def resolve(spark, data, **kw):
    return identity.resolve_entities(spark.createDataFrame(data, SCHEMA), **kw)


# ------------------------------------------------------------ independent replay

def score(a, b):
    total = 0.0
    if a[4] == b[4] and a[4] not in ("Unknown", "Other"):
        total += 0.45 * 0.70
        if a[5] == b[5] and a[5] not in ("Unknown", "Other", "", None):
            total += 0.45 * 0.30
    elif a[4] in identity.AUTOMATION_FAMILIES and b[4] in identity.AUTOMATION_FAMILIES:
        total += 0.45 * 0.20
    if a[8] and b[8]:
        total += 0.25
    if not a[8] and not b[8] and a[6] and a[6] == b[6]:
        total += 0.10
    def cls(k):
        k = (k or "").upper()
        return "h" if k in ("IAMUSER", "USER", "ROOT", "FEDERATEDUSER") else (
            "a" if k in ("ASSUMEDROLE", "SERVICEACCOUNT", "SERVICEPRINCIPAL", "ROLE") else None)
    if cls(a[7]) and cls(a[7]) == cls(b[7]):
        total += 0.20
    return round(total, 4)


def replay(data, lookback=10_800, tau=0.65, margin=0.05):
    known, made, anchors, seen, out = {}, {}, {}, {}, {}
    for e in sorted(data, key=lambda e: (e[1], e[0])):
        now, who, fed = e[1].timestamp(), e[2], e[9]
        best = None
        if fed:
            method = "federation"
            if fed not in known:
                known[fed] = e[0]
                anchors[e[0]] = e
            entity = known[fed]
            known[who] = entity
        elif who in known:
            method, entity = "fast_path", known[who]
        elif who in made:
            method, entity = "provenance", made[who]
            known[who] = entity
        else:
            options = sorted(
                ((score(e, a), x) for x, a in anchors.items() if now - seen[x] <= lookback and score(e, a) >= tau),
                reverse=True)
            if options and not (len(options) > 1 and options[0][0] - options[1][0] < margin):
                method, entity, best = "fuzzy_merge", options[0][1], options[0][0]
            else:
                method = "new_entity_ambiguous" if options else "new_entity"
                best = options[0][0] if options else None
                entity = e[0]
                anchors[entity] = e
            known[who] = entity
        if e[10]:
            made[e[10]] = entity
        seen[entity] = now
        out[e[0]] = (entity, method, best)
    return out


def compare(resolution, expected):
    got = by(resolution.events)
    founders = {r["entity_id"]: r["event_id"] for r in got.values() if r["is_new"]}
    for i, (entity, method, best) in expected.items():
        assert (founders[got[i]["entity_id"]], got[i]["method"]) == (entity, method), (i, got[i], expected[i])
        if method in ("fuzzy_merge", "new_entity_ambiguous"):
            assert got[i]["similarity"] == best


def random_events(seed, n=300, people=130, fed=0.0, made=0.0, proxies=0.3):
    random.seed(seed)
    data, span = [], 10 * 3600
    names = [f"p{j}" for j in range(people)]
    for i in range(n):
        who = random.choice(names)
        rnd = random.Random(f"{seed}-{who}")
        first = rnd.random() * span
        seconds = round(first + random.random() ** 3 * 6 * 3600, 3)
        data.append(event(
            i, seconds, who, ua=(rnd.choice(["curl", "curl", "curl", "Chrome", "Chrome", "Other", "Boto3"]), rnd.choice(["1", "1", "2", "Unknown"])),
            ip=rnd.choice(["1.1.1.1", "2.2.2.2", None]), kind=rnd.choice(["IAMUser", "User", "ServiceAccount", "Role", "Odd"]),
            proxy=rnd.random() < proxies, fed=f"f{random.randrange(6)}" if random.random() < fed else None,
            made=random.choice(names) if random.random() < made else None))
    return data


def test_documented_cases(spark):
    got = by(resolve(spark, [
        event(0, 0, "alice"), event(1, 10, "alice", made="svc-07"),
        event(2, 20, "svc-07", "GCP", ua=("Boto3", "1"), kind="ServiceAccount", ip="9.9.9.9"),
        event(3, 30, "alice", "AZURE"), event(4, 40, "carol", ua=("Firefox", "9"), kind="ServiceAccount", ip="7.7.7.7"),
    ]).events)
    assert got[2]["method"] == "provenance" and got[2]["entity_id"] == got[0]["entity_id"]
    assert got[3]["method"] == "fast_path"
    assert got[4]["method"] == "new_entity" and got[4]["entity_id"] != got[0]["entity_id"]


def test_exact_threshold_merges_and_close_scores_do_not(spark):
    got = by(resolve(spark, [event(0, 0, "a", ip="1.1.1.1"), event(1, 5, "b", ip="2.2.2.2")]).events)
    assert (got[1]["method"], got[1]["similarity"]) == ("fuzzy_merge", 0.65)
    close = [event(0, 0, "A", kind="Odd", proxy=True), event(1, 5, "B", ip="2.2.2.2"),
             event(2, 9, "C", ip="3.3.3.3", proxy=True)]
    got = by(resolve(spark, close).events)
    assert got[1]["method"] == "new_entity"
    assert got[2]["method"] == "new_entity_ambiguous"


def test_fuzzy_replay_on_random_events(spark):
    methods = set()
    for seed, proxies in ((1, 0.3), (2, 0.0), (3, 0.6), (21, 0.3)):
        data = random_events(seed, proxies=proxies)
        expected = replay(data)
        methods |= {m for _, m, _ in expected.values()}
        compare(resolve(spark, data), expected)
    assert {"fuzzy_merge", "new_entity_ambiguous", "new_entity"} <= methods


def test_all_tiers_on_random_events(spark):
    for seed in (11, 12):
        data = random_events(seed, fed=0.05, made=0.15)
        compare(resolve(spark, data), replay(data))


def test_hot_principals_are_sliced_without_effect(spark):
    data = random_events(21, fed=0.2)
    compare(resolve(spark, data, hot_rows=3, slice_us=600_000_000), replay(data))


def test_blocks_in_segments_equal_one_replay(spark):
    methods = set()
    for seed, proxies, segment_rows in ((1, 0.3, 3), (3, 0.6, 20)):
        data = random_events(seed, n=400, proxies=proxies)
        expected = replay(data)
        methods |= {m for _, m, _ in expected.values()}
        compare(resolve(spark, data, segment_rows=segment_rows), expected)
    assert {"fuzzy_merge", "new_entity_ambiguous", "new_entity"} <= methods


def test_segments_with_every_tier_and_state(spark):
    data = sorted(random_events(12, n=200, people=90, fed=0.05, made=0.15), key=lambda e: (e[1], e[0]))
    expected = replay(data)
    state, got = None, {}
    for part in (data[:100], data[100:]):
        resolved = resolve(spark, part, state=state, segment_rows=4)
        got |= by(resolved.events)
        state = identity.next_state(resolved, state, in_time_order=True)
    founders = {r["entity_id"]: r["event_id"] for r in got.values() if r["is_new"]}
    for i, (entity, method, _) in expected.items():
        assert (founders[got[i]["entity_id"]], got[i]["method"]) == (entity, method)


def hot_profile(n, ips):
    """One agent and type for everybody: long lives, short ones, pauses beyond the lookback."""
    random.seed(5)
    data, now = [], 0.0
    for i in range(n):
        now += 4 * 3600 if i % 97 == 96 else random.random() * 900
        ip = f"10.0.0.{random.randrange(ips)}"
        data.append(event(3 * i, now, f"p{i}", ip=ip))
        if i % 3 == 0:
            data.append(event(3 * i + 1, now + random.random() * 9_000, f"p{i}", ip=ip))
        if i % 20 == 0:
            data.append(event(3 * i + 2, now + 7 * 3600, f"p{i}", ip=ip))
    return data


@pytest.mark.parametrize("ips", [1, 8])
def test_a_hot_profile_uses_several_segments(spark, ips):
    data = hot_profile(500, ips)
    compare(resolve(spark, data, segment_rows=60), replay(data))
    frame = spark.createDataFrame([("b", float(e[1].timestamp())) for e in data], "block string, s double")
    placed = segments.place(frame.select("block", (F.col("s") * 1e6).cast("long").alias("at")), 60)
    assert placed.select("seg").distinct().count() > 5 and placed.where("not hot").isEmpty()


def test_sessions_inside_their_segment_tell_others_nothing(spark):
    random.seed(8)
    sessions = []
    for i in range(400):
        born = None if i % 40 == 0 else random.randrange(0, 6_400)
        begins = (born or 0) + random.choice([0, 0, random.randrange(900)])
        sessions.append(("b", f"n:{i}", begins, i, begins + random.choice([5, 300]), 0, 100, born, i % 3 == 0))
    frame = spark.createDataFrame(
        sessions, "block string, label string, at long, oid int, until long, origin long, width long, introduced_at long, proxy boolean"
    ).withColumns({"entity": F.col("label"), "ua_family": F.lit("f"), "ua_version": F.lit("1"), "kind": F.lit("k"),
                   "source_ip": F.concat(F.lit("10.0.0."), F.col("oid") % 5)})
    crossers = frame.where(segments._crosses(20)).localCheckpoint()
    assert 0 < crossers.count() < 350
    for joined in (1, 2, 4, 8):
        wanted = sorted(map(str, segments._crossing(frame, 20, joined).collect()))
        assert wanted and sorted(map(str, segments._crossing(crossers, 20, joined).collect())) == wanted


def test_batches_with_state_equal_one_pass(spark):
    data = sorted(random_events(31, fed=0.04, made=0.1), key=lambda e: (e[1], e[0]))
    expected = replay(data)
    third = len(data) // 3
    state, got = None, {}
    for part in (data[:third], data[third: 2 * third], data[2 * third:]):
        resolved = resolve(spark, part, state=state)
        got |= by(resolved.events)
        state = identity.next_state(resolved, state, in_time_order=True)
    founders = {r["entity_id"]: r["event_id"] for r in got.values() if r["is_new"]}
    for i, (entity, method, _) in expected.items():
        assert (founders[got[i]["entity_id"]], got[i]["method"]) == (entity, method), (i, got[i], expected[i])


def test_registered_fuzzy_query_matches_the_replay(spark, sf_dir):
    ev = daily_identities(spark, sf_dir)
    data = [
        (r["event_id"], r["timestamp"], r["principal"], r["source_cloud"], r["ua_family"], r["ua_version"],
         r["source_ip"], r["principal_type"], r["is_known_proxy_or_tor"], None, None)
        for r in ev.collect()
    ]
    compare(identity.resolve_entities(ev), replay(data))


def test_audit_members_and_wrong_merges(spark):
    data = [event(0, 0, "a"), event(1, 5, "b", ip="2.2.2.2"), event(2, 9, "b")]
    resolved = resolve(spark, data)
    frame = resolved.events.withColumn("gt_principal", F.col("principal")).withColumn("is_attack", F.col("event_id") % 2)
    resolved.events = frame
    audit = by(identity.merge_audit(frame))
    assert (audit[1]["tier"], audit[1]["n_keys_so_far"], audit[0]["n_keys_so_far"]) == ("2-fuzzy", 1, 0)
    wrong = rows(purity.wrong_merges(resolved))
    assert [(w["event_id"], w["ua"], w["type"], w["total"]) for w in wrong] == [(1, 0.45, 0.2, 0.65)]
    assert rows(purity.entity_purity(frame))[0]["purity"] == "mixed-label"
    assert rows(purity.signal_blame(purity.wrong_merges(resolved)))[0]["wrong_merges"] == 1


def test_purge_forgets_idle_entities(spark):
    resolved = resolve(spark, [event(0, 0, "a"), event(1, 90_000, "z", ua=("Firefox", "1"))])
    state = identity.next_state(resolved)
    now = int(at(90_000).timestamp() * 1_000_000)
    kept, purged = identity.purge(state, now, 86_400)
    assert purged.count() == 1
    assert [r["key"] for r in kept.identity.collect()] == ["z"]


def test_weights_that_break_blocking_are_refused():
    with pytest.raises(ValueError):
        identity.StitchParams(similarity_threshold=0.5)
