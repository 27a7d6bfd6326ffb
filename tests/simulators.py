"""Record-by-record models of the stateful rules, used as oracles for the set-based operators."""

from __future__ import annotations

EPOCH = 0


def record_prices(observations):
    """[(ts, value)] in order -> [[value, start, end]] by the strict rule."""
    history = []
    for ts, value in observations:
        open_rows = [h for h in history if h[2] is None]
        latest = max(open_rows, key=lambda h: h[1]) if open_rows else None
        if latest is not None:
            latest[2] = ts
            if latest[0] == value:
                continue
        history.append([value, ts, None])
    return history


def coalesce_prices(observations):
    history = []
    for ts, value in observations:
        if history and history[-1][0] == value:
            continue
        if history:
            history[-1][2] = ts
        history.append([value, ts, None])
    return history


def fold_product(events):
    """[(ts, kind, name, date)] in order -> state dict or None."""
    row = None
    for ts, kind, name, date in events:
        if kind == "404":
            if row is not None:
                row["active"], row["checked"] = False, ts
            continue
        if row is None:
            row = {
                "name": name, "seen": ts, "checked": EPOCH, "active": True,
                "first": date, "first_at": ts if date else None,
                "latest": date, "latest_at": ts if date else None,
            }
            continue
        if row["first"] is None and date is not None:
            row["first"], row["first_at"] = date, ts
        row.update(
            name=name, checked=ts, active=True, latest=date, latest_at=ts if date else None
        )
    return row


def merge_shards(products, history, shards):
    """Apply shards one after the other.

    products: {url: {checked, active, name}}, history: {url: [[price, start, end]]};
    a shard is the same pair.
    """
    for shard_products, shard_history in shards:
        for url, theirs in shard_products.items():
            ours = products.get(url)
            if ours is None or theirs["checked"] <= ours["checked"]:
                continue
            ours.update(theirs)
            mine = history.setdefault(url, [])
            open_rows = sorted((h for h in mine if h[2] is None), key=lambda h: h[1])
            if not theirs["active"]:
                if open_rows:
                    open_rows[-1][2] = theirs["checked"]
                continue
            listed = shard_history.get(url, [])
            if not listed:
                continue
            newest = max(listed, key=lambda h: h[1])
            latest = max(mine, key=lambda h: h[1]) if mine else None
            if latest is not None and latest[1] == newest[1]:
                latest[2] = newest[2]
            else:
                if open_rows:
                    open_rows[-1][2] = newest[1]
                mine.append(list(newest))
    return products, history
