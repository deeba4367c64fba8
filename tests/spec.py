"""Sequential statements of what the operators compute, for one series at a time."""


def margin(iv, m, end=None):
    out = []
    for i, (s, e) in enumerate(iv):
        a, b = max(0, s + m), e - m
        if i + 1 < len(iv) and e < iv[i + 1][0]:
            b = min(b, (e + iv[i + 1][0]) // 2)
        if i and iv[i - 1][1] < s:
            a = max(a, (iv[i - 1][1] + s) // 2)
        if end is not None:
            b = min(b, end)
        if a < b:
            out.append((a, b))
    return merge(out)


def merge(iv, joins=lambda gap: gap < 0):
    out = []
    for s, e in sorted(iv):
        if out and joins(s - out[-1][1]):
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def keep(iv, end, floor):
    at, gaps = 0, []
    for s, e in sorted((max(0, s), min(end, e)) for s, e in iv):
        if e <= s:
            continue
        if at < s:
            gaps.append((at, s))
        at = max(at, e)
    if at < end:
        gaps.append((at, end))
    return merge([g for g in gaps if g[1] - g[0] >= floor], lambda gap: gap < floor)


def quiet(rows, threshold, min_len, end=None):
    """``rows`` are (time, value) in order."""
    out, start = [], None
    for t, v in rows:
        if abs(v) < threshold:
            start = t if start is None else start
        elif start is not None:
            out.append((start, t))
            start = None
    if start is not None and end is not None and start < end:
        out.append((start, end))
    return [(s, e) for s, e in out if e - s >= min_len]


def throttle(rows, interval):
    """``rows`` are (time, forced)."""
    out, last = [], None
    for t, forced in rows:
        if forced or last is None or t - last >= interval:
            out.append(t)
            last = t
    return out


def ema(values, alpha):
    out, s = [], None
    for v in values:
        if v is not None:
            v = max(0.0, v)
            s = v if s is None else s + alpha * (v - s)
        out.append(s)
    return out
