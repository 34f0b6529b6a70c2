"""The resolver's rules once more, written down as plainly as possible: no index, no class, nothing found beforehand.

Only fixed values (word lists, patterns of collective names) are shared with the library.
"""

import re

from storyloom.functions.text import COLLECTIVE, GENERIC, SENIOR


def hard(name):
    """collective or invalid; None for a name that may be a person's."""
    if name is None or len(name) > 50 or not name.strip() or re.fullmatch(r"\d+", name) or all(c in "!@#$%^&*()_+-=[]{};':\"\\|,.<>/?~`" for c in name):
        return "invalid"
    return "collective" if re.match(COLLECTIVE, name) else None


def resolve(chunks, judge):
    """chunks: dicts in order; judge(text, asked) -> answers. What becomes of a novel, as a dict of plain lists."""
    known, names_of, provisional = {}, {}, set()
    seen_by_role, confirmed_roles, barred_roles = {}, set(), set()
    count, out = {}, {k: [] for k in ("characters", "relations", "aliases", "bridges", "registered", "promoted", "gone")}

    def tally(what):
        count[what] = count.get(what, 0) + 1

    for chunk in chunks:
        here, text, body = chunk["chunk_id"], chunk["text"], chunk["section_type"] == "body"
        people = [(c["name"], c["category"]) for c in chunk["characters"]]
        links = [(i, r["source"], r["target"]) for i, r in enumerate(chunk["relationships"]) if r["source"] != r["target"]]
        said = {n: c for n, c in people if c is not None}
        category = lambda n: "generic" if n in GENERIC else said.get(n)  # noqa: E731, B023
        mentioned = {n for n, _ in people} | {n for _, a, b in links for n in (a, b)}
        shown = {known[n] for n in mentioned if not hard(n) and n in known and not hard(known[n]) and known[n] not in provisional}
        in_text = lambda: {c for c, own in names_of.items() if not hard(c) and any(n in text for n in own)}  # noqa: E731, B023
        texts, pending, deferred, gone, kept = in_text(), {}, [], set(), []

        def candidates(m):
            rest = sorted(c for c in names_of if c != m and not hard(c))
            strong = [c for c in rest if c in shown] + [c for c in rest if c in texts and c not in shown]  # noqa: B023
            score = lambda c: (-any(m in n or n in m for n in names_of[c]), -max(len(set(m) & set(n)) for n in names_of[c]), c)
            return strong + sorted((c for c in rest if c not in strong), key=score)[: max(0, 5 - len(strong))]

        def register(n):
            known[n] = n
            out["registered"].append((n, here, body))  # noqa: B023
            if body:  # noqa: B023
                names_of[n] = {n}
            else:
                provisional.add(n)
                tally("nonbody_person_provisional")

        def nobody(m):
            """A mention for which there is no canonical."""
            if category(m) == "generic":  # noqa: B023
                gone.add(m)  # noqa: B023
            elif category(m) in ("descriptive", "composite"):  # noqa: B023
                gone.add(m)  # noqa: B023
                tally(f"{category(m)}_unresolved" if body else "nonbody_descriptive_dropped")  # noqa: B023
            elif m not in known:
                register(m)

        def stays(m):
            """One occurrence; whether it is kept for now."""
            if m in known:
                if known[m] in provisional and body:  # noqa: B023
                    provisional.discard(known[m])
                    names_of.setdefault(known[m], set()).add(known[m])
                    out["promoted"].append((known[m], here))  # noqa: B023
                if known[m] not in provisional:
                    shown.add(known[m])  # noqa: B023
            elif found := candidates(m):
                pending[m] = found  # noqa: B023
            elif category(m) == "generic":  # noqa: B023
                tally("generic_filtered")
                return False
            elif category(m) in ("descriptive", "composite"):  # noqa: B023
                if not body:  # noqa: B023
                    tally("nonbody_descriptive_dropped")
                    gone.add(m)  # noqa: B023
                    return False
                if m not in deferred:  # noqa: B023
                    deferred.append(m)  # noqa: B023
            else:
                register(m)
                if body:  # noqa: B023
                    shown.add(m)  # noqa: B023
            return True

        def admitted(m, target):
            if (m, target) in confirmed_roles:
                return True
            if of := re.match("^(.{1,4})的(.{1,8})$", m):
                anchor, head = known.get(of[1]), of[2]
            else:
                prefixes = [m[:k] for k in range(2, len(m) + 1) if m[:k] in known]
                if prefixes and prefixes[-1] != m:
                    anchor, head = known[prefixes[-1]], m[len(prefixes[-1]) :]
                    if target == anchor:
                        return True
                else:
                    if category(m) != "descriptive" or m[0] not in SENIOR:  # noqa: B023
                        return True
                    if m in barred_roles:
                        return False
                    who, where = seen_by_role.setdefault(m, (target, set()))
                    if who != target:
                        barred_roles.add(m)
                        seen_by_role.pop(m)
                        return False
                    where.add(here)  # noqa: B023
                    if len(where) == 1:
                        return False
                    confirmed_roles.add((m, target))
                    seen_by_role.pop(m)
                    return True
            return target == head and (anchor is None or any(n in text for n in {anchor, *names_of.get(anchor, ())}))  # noqa: B023

        for i, (n, _) in enumerate(people):
            if hard(n):
                tally(f"{hard(n)}_filtered")
            elif stays(n):
                kept.append(("character", i, n))
        for i, a, b in links:
            if not hard(a) and not hard(b) and stays(a) and stays(b):
                kept += [("source", i, a), ("target", i, b)]
        if deferred:
            texts = in_text()
            for m in deferred:
                if found := candidates(m):
                    pending[m] = found
                else:
                    nobody(m)
        for m, found in pending.items():
            own = sorted(c for c in found if known.get(c) == c)
            out["bridges"] += [(m, here, a, b) for k, a in enumerate(own) for b in own[k + 1 :]]
        answers = {}
        if pending:
            for a in judge(text, [{"mention": m, "candidates": [{"canonical": c, "matched_names": sorted(names_of[c])} for c in found]} for m, found in pending.items()]):
                answers.setdefault(a["mention"], a["resolves_to"])
        for m, found in pending.items():
            target = answers.get(m)
            if target is None or target not in found or hard(target) or known.get(target) != target:
                nobody(m)
            elif admitted(m, target):
                known[m] = target
                names_of[target].add(m)
                out["aliases"].append((target, m))
                if said.get(m) in ("descriptive", "composite"):
                    tally(f"{said[m]}_resolved")
            else:
                gone.add(m)
        out["gone"] += [(n, here) for n in gone]
        final = {(part, i): known.get(n, n) for part, i, n in kept if n not in gone}
        firsts = dict.fromkeys(who for (part, _), who in sorted(final.items(), key=lambda x: x[0][1]) if part == "character")
        out["characters"] += [(here, chunk["chapter_id"], k, who, body) for k, who in enumerate(firsts)]
        for i, _, _ in links:
            a, b = final.get(("source", i)), final.get(("target", i))
            if a and b and a != b:
                out["relations"].append((here, i, a, b))
    count["nonbody_provisional_dropped"] = len(provisional)
    last_gone = {}
    for n, at in out["gone"]:
        last_gone[n] = at
    out["bridges"] = [(m, at, a, b) for m, at, a, b in out["bridges"] if at > last_gone.get(m, -1)]
    promoted = dict(reversed(out["promoted"]))
    out["dropped"] = sorted({n for n, _, b in out["registered"] if not b} - promoted.keys())
    first_seen = promoted | {n: at for n, at, b in out["registered"] if b}
    out["canonicals"] = sorted(
        (n, at, len({c for c, _, _, who, b in out["characters"] if who == n and b}), sorted({ch for _, ch, _, who, b in out["characters"] if who == n and b}), list(dict.fromkeys(m for t, m in out["aliases"] if t == n and m != n)))
        for n, at in first_seen.items()
    )
    out["counters"] = {k: v for k, v in count.items() if v}
    return out
