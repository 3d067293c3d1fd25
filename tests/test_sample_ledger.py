"""A ledger of fourteen monthly files made by a rule, against plain Python:
the same figures that the goldens of the sample files check, without them."""

import statistics
from collections import Counter, defaultdict
from decimal import Decimal

import pytest

from ledgerlens.operators import balances as bal
from ledgerlens.operators import detect as det
from ledgerlens.operators import validate as va
from ledgerlens.sources import files as fs

MONTHS = [f"{2024 + (9 + k) // 12}-{(9 + k) % 12 + 1:02d}" for k in range(14)]
ACCOUNTS = [str(4000 + 100 * k) for k in range(27)]


def amount(a, m):
    """Steady accounts, growing ones, jumps, sign changes; in cents."""
    base = 10_000_00 + 731_17 * a
    wave = (a * 37 + m * m * 11 + a * m * 5) % 41 - 20
    jump = 3 if (a + 2 * m) % 17 == 0 else 1
    sign = -1 if (a * m) % 29 == 28 else 1
    return Decimal(sign * (base * jump + base * wave // (60 if a % 3 else 250))) / 100


def sample():
    """(account, month) to balance; account 5 skips a month, account 7 has two rows a month."""
    return {(acc, m): amount(a, k) for a, acc in enumerate(ACCOUNTS) for k, m in enumerate(MONTHS) if not (a == 5 and k == 6)}


@pytest.fixture(scope="module")
def enriched(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sample")
    rows = sample()
    for k, m in enumerate(MONTHS):
        lines = ["transaction_id,gl_account_id,date,amount,description,department,vendor"]
        for a, acc in enumerate(ACCOUNTS):
            if (acc, m) not in rows:
                continue
            parts = [rows[acc, m] - 1, Decimal(1)] if a == 7 else [rows[acc, m]]
            lines += [f'T{k:02d}{a:02d}{j},{acc},{m}-15,{x},"Monthly {acc}, {m}",Operations,Vendor_{acc}' for j, x in enumerate(parts)]
        (folder / f"pl_{m}.csv").write_text("\n".join(lines) + "\n")
    (folder / "accounts.csv").write_text("account_id,account_name,category\n" + "\n".join(
        f"{acc},Account {acc},{'revenue' if a < 3 else 'expense'}" for a, acc in enumerate(ACCOUNTS)) + "\n")
    ledger = va.project_ledger(fs.scan_ledger_months(spark, str(folder)))
    assert ledger.count() == 27 * 14 - 1 + 14
    accounts = va.project_accounts(fs.scan_accounts(spark, str(folder / "accounts.csv"))).cache()
    return bal.enrich_balances(bal.monthly_balances(ledger)).cache(), accounts


def changes():
    """(account, month) to (variance percent, previous balance), by the month before."""
    rows, out = sample(), {}
    for k, m in enumerate(MONTHS[1:], 1):
        for acc in ACCOUNTS:
            cur, prev = rows.get((acc, m)), rows.get((acc, MONTHS[k - 1]))
            if cur is not None and prev:
                out[acc, m] = (float(cur - prev) / float(abs(prev)) * 100, prev)
    return out


def test_counts_and_ranks_of_every_month(enriched):
    flags = det.detect_anomalies(*enriched)
    want = {k: v[0] for k, v in changes().items() if abs(v[0]) >= 15}
    got = flags.collect()
    assert {(r.gl_account_id, r.current_month) for r in got} == set(want)
    for r in got:
        v = want[r.gl_account_id, r.current_month]
        assert abs(r.variance_percent - v) < 1e-6
        assert r.severity == ("high" if abs(v) > 30 else "medium" if abs(v) > 15 else "low")
        assert r.direction == ("increase" if v > 0 else "decrease")
    counts = Counter(m for _, m in want)
    assert {r.current_month: r.anomalies_detected for r in det.severity_counts(flags, enriched[1]).collect()} == counts and len(counts) == 13
    order = defaultdict(list)
    for r in det.rank_anomalies(flags).collect():
        order[r.current_month].append((r.gl_account_id, abs(r.variance_percent)))
    for m, ranked in order.items():
        assert [x for _, x in ranked] == sorted((x for _, x in ranked), reverse=True) and len(ranked) == counts[m]


def test_month_totals_and_categories(enriched):
    rows = sample()
    total, by_kind = defaultdict(Decimal), defaultdict(Decimal)
    for (acc, m), x in rows.items():
        total[m] += x
        by_kind["revenue" if acc in ACCOUNTS[:3] else "expense", m] += x
    got = {(r.category, f"{r.month:%Y-%m}"): r.net_balance for r in bal.category_variance(
        enriched[0].select("gl_account_id", "month", "net_balance", "transaction_count"), enriched[1]).where("level IN (1, 3)").collect()}
    assert got == {**by_kind, **{(None, m): x for m, x in total.items()}}
    assert enriched[0].where("gl_account_id = '4700' AND transaction_count <> 2").count() == 0


def test_rolling_statistics(enriched):
    rows, seen = sample(), 0
    have = {(r.gl_account_id, f"{r.month:%Y-%m}"): r for r in enriched[0].collect()}
    assert set(have) == set(rows)
    for acc in ACCOUNTS:
        own = [(m, rows[acc, m]) for m in MONTHS if (acc, m) in rows]
        for k, (m, x) in enumerate(own):
            before = [float(b) for _, b in own[max(0, k - 6):k]]
            r = have[acc, m]
            assert (r.rolling_3mo_avg is None) == (k < 3) and (r.rolling_6mo_std is None) == (k < 6)
            if k >= 3:
                assert abs(r.rolling_3mo_avg - statistics.fmean(before[-3:])) < 1e-3
            if k >= 6:
                std = statistics.stdev(before)
                assert abs(r.rolling_6mo_std - std) < 1e-3
                z = (float(x) - statistics.fmean(before)) / std
                assert abs(r.z_score - z) < 1e-3 and r.is_statistical_outlier == (abs(r.z_score) > 2)
                seen += 1
    assert seen == 27 * 8 - 1
