"""Plain Python versions of the statements that the operators must meet, for small inputs."""

import collections
import hashlib
import json
import re
import unicodedata


def nfc(s):
    return unicodedata.normalize("NFC", s)


def file_no(name):
    return int(re.search(r"(\d+)\s*$", name)[1])


def current_rows(feed):
    once = {(e["entity"], file_no(e["binlog_file"]), e["binlog_pos"], e["row_no"]): e for e in feed}
    rows = {}
    for k in sorted(once):
        e = once[k]
        if e["pk"] is None or not e["pk"].strip():
            continue
        op, pk = (e["op_type"] or "").strip().upper(), (e["entity"], e["tbl"], nfc(e["pk"]))
        values = dict(zip(e["row_columns"] or [], e["row_values"] or []))
        if op == "INSERT":
            rows[pk] = values
        elif op == "DELETE":
            rows.pop(pk, None)
        elif op == "UPDATE":
            before = e["pk_before"]
            if before is not None and before.strip() and nfc(before) != pk[2]:
                rows.pop((*pk[:2], nfc(before)), None)
                rows[pk] = values
            elif pk in rows:
                rows[pk] = {**rows[pk], **values}
    return {(*k, hashlib.md5("|".join(f"{a}={v}" for a, v in sorted(r.items()) if v).encode()).hexdigest()) for k, r in rows.items()}


def spec_entries(ops):
    best = {}
    for o in ops:
        try:
            d = json.loads(o["spec"])
        except (TypeError, ValueError):
            continue
        if o["op_id"] not in best or o["spec_version"] > best[o["op_id"]][0]:
            best[o["op_id"]] = (o["spec_version"], d)
    out = set()

    def items(v):
        return v if isinstance(v, list) else [] if v is None else [v]

    for op, (_, d) in best.items():
        if not isinstance(d, dict):
            continue
        e = d if d.get("details") is None else d["details"]
        e = json.loads(e) if isinstance(e, str) else e

        def add(path, x, label, op=op):
            if isinstance(x, str):
                out.add((op, path, x))
            elif isinstance(x, dict):
                out.add((op, path, "" if x.get(label) is None else x[label]))

        for i, j in enumerate(items(e.get("joins"))):
            add(f"joins[{i}]", j, "alias")
            for name, label in (("on", "left"), ("filters", "field")):
                for k, x in enumerate(items(j.get(name)) if isinstance(j, dict) else []):
                    add(f"joins[{i}].{name}[{k}]", x, label)
        for name in ("filters", "select"):
            for k, x in enumerate(items(e.get(name))):
                add(f"{name}[{k}]", x, "field")

        def tree(n, path, add=add):
            children = items(n.get("children")) if isinstance(n, dict) else []
            for i, x in enumerate(children):
                tree(x, f"{path}.children[{i}]")
            if not children:
                add(path, n, "field")

        tree(e.get("filter_tree"), "filter_tree")
    return out


def drift(manifests, rows):
    by = {}
    for m in manifests:
        if m["original_fields"]:
            by.setdefault((m["entity"], m["tbl"]), {})[m["manifest_version"]] = m
    records = collections.defaultdict(dict)
    for r in rows:
        records[r["entity"], r["tbl"], r["schema_version"]][r["rec_key"]] = {k.lower(): v for k, v in json.loads(r["row_json"]).items()}
    out = set()
    for t, versions in by.items():
        order = sorted(versions)
        for a, b in zip(order, order[1:]):
            old, new = ([x.lower() for x in versions[v]["original_fields"]] for v in (a, b))
            kinds = [dict(zip(f, [x.lower().split("(")[0].strip() for x in versions[v]["field_types"]])) for f, v in ((old, a), (new, b))]
            gone, fresh = [x for x in old if x not in new], [x for x in new if x not in old]
            shared = [(records[(*t, a)][k], records[(*t, b)][k]) for k in records[(*t, a)].keys() & records[(*t, b)].keys()]
            pairs = [(g, n) for g in gone for n in fresh if shared and all(x.get(g) == y.get(n) for x, y in shared) and any(x.get(g) is not None for x, _ in shared)]
            was, now = {g for g, _ in pairs}, {n for _, n in pairs}
            out |= {(*t, b, n, "renamed" if n in now else "added") for n in fresh} | {(*t, b, g, "removed") for g in gone if g not in was}
            out |= {(*t, b, f, "retyped") for f in old if f in new and kinds[0].get(f) != kinds[1].get(f)}
            keys = [[x.lower() for x in (versions[v]["primary_key_columns"] or [versions[v]["primary_key"]])] for v in (a, b)]
            if keys[0] != keys[1]:
                out.add((*t, b, "", "key_changed"))
    return out


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]
