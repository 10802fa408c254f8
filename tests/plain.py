"""Plain-Python answers the operators are compared with."""

import math
import random
from datetime import datetime, timedelta

GAME_SCHEMA = ("game_id bigint, league string, date timestamp_ntz, year int, round int, venue string, home_team string, "
               "away_team string, home_score int, away_score int")


def make_games(n=300, teams=5, leagues=2, seed=1, days=90):
    """Games with draws, upcoming rows between played ones, date ties and a hot team."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        home = "T0" if rnd.random() < 0.4 else f"T{rnd.randrange(teams)}"
        away = rnd.choice([f"T{j}" for j in range(teams) if f"T{j}" != home])
        date = datetime(2020, 11, 1) + timedelta(days=rnd.randrange(days))
        played = rnd.random() > 0.25
        hs, as_ = (rnd.randrange(4) * 5, rnd.randrange(4) * 5) if played else (None, None)
        rows.append((i, f"L{rnd.randrange(leagues)}", date, date.year, date.month, f"V{rnd.randrange(3)}", home, away, hs, as_))
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[2], r[0]))


def elo(rows, k=30.0, adv=30.0, revert=0.1):
    out = {}
    for league in {r[1] for r in rows}:
        rating, season = {}, None
        for r in in_order([x for x in rows if x[1] == league]):
            if r[3] != season:
                rating = {t: v * (1 - revert) + 1500 * revert for t, v in rating.items()}
                season = r[3]
            h, a = rating.get(r[6], 1500.0), rating.get(r[7], 1500.0)
            out[r[0]] = (h, a)
            if r[8] is None:
                continue
            expected = 1 / (1 + 10 ** ((a - h - adv) / 400))
            actual = 1.0 if r[8] > r[9] else 0.5 if r[8] == r[9] else 0.0
            shift = k * math.log(max(abs(r[8] - r[9]), 1) + 1) / math.log(11) * (actual - expected)
            rating[r[6]], rating[r[7]] = h + shift, a - shift
    return out


def team_features(rows):
    """form over 5, spread, streak, rest, away run per (game, side)."""
    out = {}
    past, away_run = {}, {}
    for r in in_order(rows):
        for side, team, sf, sa in (("home", r[6], r[8], r[9]), ("away", r[7], r[9], r[8])):
            seen = past.get((r[1], team), [])
            last = seen[-5:]
            margins = [f - a for _, f, a in last]
            streak = None
            if seen:
                sign = [(f > a) - (f < a) for _, f, a in seen]
                streak = 0
                if sign[-1]:
                    for s in reversed(sign):
                        if s != sign[-1]:
                            break
                        streak += s
            out[r[0], side] = {
                "win_rate_5": sum(f > a for _, f, a in last) / len(last) if last else None,
                "avg_margin_5": sum(margins) / len(margins) if last else None,
                "volatility": (math.sqrt(sum((m - sum(margins) / len(margins)) ** 2 for m in margins) / (len(margins) - 1))
                               if len(margins) > 1 else None),
                "streak": streak,
                "rest": min((r[2] - seen[-1][0]).days, 30) if seen else None,
                "away_run": away_run.get((r[1], team), 0),
            }
        for side, team, sf, sa in (("home", r[6], r[8], r[9]), ("away", r[7], r[9], r[8])):
            if sf is not None:
                past.setdefault((r[1], team), []).append((r[2], sf, sa))
            away_run[r[1], team] = 0 if side == "home" else away_run.get((r[1], team), 0) + 1
    return out


def ledger(bets, bankroll=1000.0):
    """bets: (key, order, id, share, odds, won)."""
    out, money = {}, {}
    for key, _, game, share, odds, won in sorted(bets, key=lambda b: (b[0], b[1])):
        cash = money.get(key, bankroll)
        amount = cash * share
        if amount < 1:
            continue
        cash += amount * (odds - 1) if won else -amount
        money[key] = cash
        out[key, game] = (amount, cash)
    return out
