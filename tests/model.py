"""The semantics once more, in plain Python, one record at a time."""

import math


def strip(text):
    return (text or "").strip()


def turn_pairs(system, turns):
    """`turns` is a list of (human, assistant)."""
    said, out = [system.strip()] if strip(system) else [], []
    for human, assistant in turns:
        human, assistant = strip(human), strip(assistant)
        if not human or not assistant:
            continue
        out.append(("\n".join([*said, human]), assistant))
        said += [human, assistant]
    return out


def message_pairs(prefix, messages):
    """`messages` is a list of (role, text)."""
    out = []
    for (role, text), (next_role, answer) in zip(messages, messages[1:]):
        if role == "user" and next_role == "assistant" and answer.strip():
            asked = f"{prefix}\n{text}" if prefix else text
            out.append((asked.strip(), answer.strip()))
    return out


def rows_to_turn_pairs(rows):
    """History pairs of one conversation's (turn, role, text) rows."""
    rows = sorted(rows)
    system = next((text for _, role, text in rows if role == "system"), None)
    said, out = [system.strip()] if strip(system) else [], []
    for (turn, role, text), (_, next_role, answer) in zip(rows, rows[1:]):
        if role == "user" and next_role == "assistant" and text.strip() and answer.strip():
            out.append((turn, "\n".join([*said, text.strip()]), answer.strip()))
            said += [text.strip(), answer.strip()]
    return out


def rows_to_message_pairs(rows):
    rows = sorted(rows)
    system = next((text for _, role, text in rows if role == "system"), None)
    out = []
    for (turn, role, text), (_, next_role, answer) in zip(rows, rows[1:]):
        if role == "user" and next_role == "assistant" and answer.strip():
            asked = f"{system}\n{text}" if system else text
            out.append((turn, asked.strip(), answer.strip()))
    return out


def vocabulary(texts):
    special = ["<pad>", "<bos>", "<eos>", chr(0x0F0B)]
    ids = {t: i for i, t in enumerate(special)}
    for ch in sorted(set("".join(texts))):
        ids.setdefault(ch, len(ids))
    return ids


def encode(ids, text):
    return [1, *(ids.get(ch, 3) for ch in text), 2]


def pack(lists, size, group):
    """`(group, block, ids)` of id lists in order."""
    out = []
    for g in range(0, len(lists), group):
        joined = [i for ids in lists[g : g + group] for i in ids]
        end = len(joined) // size * size if len(joined) >= size else len(joined)
        out += [(g // group, b, joined[a : min(a + size, end)]) for b, a in enumerate(range(0, end, size))]
    return out


def context(history, n):
    if n > 0 and len(history) > 2 * n:
        system = [m for m in history if m[1] == "system"]
        return system + [m for m in history if m[1] != "system"][-2 * n :]
    return history


def early_stop(losses, patience, threshold):
    """`(stop index or None, best, bad, seen)` of losses in order."""
    best, bad = math.inf, 0
    for seen, loss in enumerate(losses, 1):
        if loss < best - threshold:
            best, bad = loss, 0
        else:
            bad += 1
        if bad >= patience:
            return seen - 1, best, bad, seen
    return None, best, bad, len(losses)


def learning_rate(step, base, warmup, total, floor=0.1):
    if step < warmup:
        return base * step / max(1, warmup)
    return base * (floor + (1 - floor) * 0.5 * (1 + math.cos(math.pi * (step - warmup) / max(1, total - warmup))))
