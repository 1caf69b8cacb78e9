"""Plain-Python models of the fan-in rules, for small inputs."""


def by_id(messages):
    ids = {}
    for id, slot, value, seq in messages:
        ids.setdefault(id, []).append((seq, slot, value))
    return {id: sorted(rows) for id, rows in ids.items()}


def distinct(messages, n, dup, cycles="all"):
    out = set()
    for id, rows in by_id(messages).items():
        held, cycle = {}, 0
        for seq, slot, value in rows:
            if not 0 <= slot < n:
                continue
            if dup == "last" or slot not in held:
                held[slot] = value
            if len(held) == n:
                out.add((id, cycle, seq, tuple(held[k] for k in range(n))))
                held, cycle = {}, cycle + 1
                if cycles == "first":
                    break
    return out


def arrivals(messages, n, fill=None):
    out = set()
    for id, rows in by_id(messages).items():
        held, count, cycle = {}, 0, 0
        for seq, slot, value in rows:
            held[slot] = value
            count += 1
            if count == n:
                out.add((id, cycle, seq, tuple(held.get(k, fill) for k in range(n))))
                count, cycle = 0, cycle + 1
    return out


def batch_arrivals(messages, n, fill=None):
    """``messages`` are ``(id, slot, value, seq, group)``; groups count as a whole."""
    out, ids = set(), {}
    for id, slot, value, seq, group in messages:
        ids.setdefault(id, {}).setdefault(group, []).append((seq, slot, value))
    for id, groups in ids.items():
        held, count, cycle = {}, 0, 0
        for _, rows in sorted(groups.items()):
            for _, slot, value in sorted(rows):
                held[slot] = value
            count += len(rows)
            if count >= n:
                out.add((id, cycle, max(rows)[0], tuple(held.get(k, fill) for k in range(n))))
                count, cycle = 0, cycle + 1
    return out


def rounds(messages, ttl):
    """The messages by ``(id, round)``; ``seq`` is the time."""
    out = []
    for id, rows in by_id(messages).items():
        last, number = None, 0
        for seq, slot, value in rows:
            number += last is not None and seq - last >= ttl
            last = seq
            out.append(((id, int(number)), slot, value, seq))
    return out
