"""Ordered replay of fuzzy decisions inside one segment of a block (see ``segments``).

Rows arrive sorted by (block, seg, time, id, step): step -1 brings an entity that is active
when the segment begins, step 0 introduces an identity, step 1 opens one of its activity
sessions. A session whose identity was introduced in an earlier segment names its entity.
Memory holds active entities and identities with sessions ahead of them; rows stream
through in Arrow batches.
"""

from __future__ import annotations

import heapq

import pandas as pd

RESULT_SCHEMA = "block string, seg bigint, label string, method string, owner string, similarity double"
_SILENT_FAMILIES = ("Unknown", "Other", "", None)
_SILENT_VERSIONS = ("Unknown", "Other", "", None)


def _text(value):
    return None if value is None or value != value else value


class Block:
    """Active entities of one block, counted by profile and by address."""

    def __init__(self, params):
        self.p = params
        self.owner = {}      # identity label -> entity label
        self.live = {}       # entity label -> identities with sessions ahead
        self.profile = {}    # entity label -> (profile, ip)
        self.until = {}      # entity label -> end of its activity
        self.active = {}     # profile -> {entity label}
        self.by_ip = {}      # (profile, ip) -> {entity label}
        self.heap = []
        self.scores = {}

    def pair_score(self, a, b, same_ip):
        key = (a, b, same_ip)
        if key not in self.scores:
            p, total = self.p, 0.0
            if a[0] == b[0] and a[0] not in _SILENT_FAMILIES:
                total += p.ua_weight * 0.70
                if a[1] == b[1] and a[1] not in _SILENT_VERSIONS:
                    total += p.ua_weight * 0.30
            if a[2] and b[2]:
                total += p.proxy_weight
            elif same_ip and not a[2] and not b[2]:
                total += p.ip_weight
            if a[3] is not None and a[3] == b[3]:
                total += p.type_weight
            self.scores[key] = round(total, 4)
        return self.scores[key]

    def expire(self, now):
        while self.heap and self.heap[0][0] < now - self.p.lookback_us:
            end, entity = heapq.heappop(self.heap)
            if self.until.get(entity) == end:
                profile, ip = self.profile[entity]
                self.active[profile].discard(entity)
                if not self.active[profile]:
                    del self.active[profile]
                self.by_ip.get((profile, ip), set()).discard(entity)
                if not self.by_ip.get((profile, ip), True):
                    del self.by_ip[(profile, ip)]
                del self.until[entity]
                self.forget(entity)

    def forget(self, entity):
        if not self.live.get(entity) and entity not in self.until:
            self.live.pop(entity, None)
            self.profile.pop(entity, None)

    def introduce(self, label, profile, ip, must_found):
        """Decide the entity of a new identity."""
        method, score, entity = "new_entity", None, label
        if not must_found:
            options = []
            for other, members in self.active.items():
                near = self.by_ip.get((other, ip), ()) if ip else ()
                if near:
                    options.append((self.pair_score(profile, other, True), len(near), near, ()))
                if len(members) > len(near):
                    options.append(
                        (self.pair_score(profile, other, False), len(members) - len(near), members, near)
                    )
            options = [o for o in options if o[0] >= self.p.similarity_threshold]
            if options:
                options.sort(key=lambda o: o[0], reverse=True)
                score = options[0][0]
                if options[0][1] > 1:
                    second = score
                else:
                    second = options[1][0] if len(options) > 1 else None
                if second is not None and score - second < self.p.ambiguity_margin:
                    method = "new_entity_ambiguous"
                else:
                    _, _, members, without = options[0]
                    entity = next(m for m in members if m not in without)
                    method = "fuzzy_merge"
        self.owner[label] = entity
        if entity == label:
            self.profile[label] = (profile, ip)
        self.live[entity] = self.live.get(entity, 0) + 1
        return method, entity, score

    def activate(self, entity, end):
        """The entity is active until ``end`` and the lookback after it."""
        if entity not in self.until:
            profile, ip = self.profile[entity]
            self.active.setdefault(profile, set()).add(entity)
            if ip and not profile[2]:
                self.by_ip.setdefault((profile, ip), set()).add(entity)
            self.until[entity] = end
            heapq.heappush(self.heap, (end, entity))
        elif end > self.until[entity]:
            self.until[entity] = end
            heapq.heappush(self.heap, (end, entity))

    def open_session(self, label, end, last):
        entity = self.owner[label]
        self.activate(entity, end)
        if last:
            del self.owner[label]
            self.live[entity] -= 1


_COLUMNS = (
    "block", "seg", "label", "at", "step", "must_found", "ua_family", "ua_version", "proxy", "kind",
    "source_ip", "until", "last_burst", "entity",
)


def replay_blocks(params):
    """Function for ``mapInPandas``; state restarts with every segment."""

    def run(batches):
        current, block = None, None
        for batch in batches:
            out = []
            for (
                name, seg, label, at, step, must_found, family, version, proxy, kind, ip, until, last, entity
            ) in zip(*[batch[c].tolist() for c in _COLUMNS]):
                if (name, seg) != current:
                    current, block = (name, seg), Block(params)
                if at == at and at is not None:
                    block.expire(at)
                entity = _text(entity)
                if step == 0 or entity is not None:
                    profile, ip = (_text(family), _text(version), bool(proxy), _text(kind)), _text(ip)
                if step == 0:
                    method, owner, score = block.introduce(label, profile, ip, bool(must_found))
                    if not must_found:
                        out.append((name, seg, label, method, owner, score))
                elif entity is not None:
                    block.profile.setdefault(entity, (profile, ip))
                    block.activate(entity, int(until))
                elif label in block.owner:
                    block.open_session(label, int(until), bool(last))
            yield pd.DataFrame(
                out, columns=["block", "seg", "label", "method", "owner", "similarity"]
            ).astype({"similarity": "float64", "seg": "int64"})

    return run
