"""Reading at the edge of a cycle: rates with a lifetime (SRC-28), sources that fail alone (SUP-01, SUP-06, SUP-11), price enrichment (SRC-14)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.state import Snapshots

HOME = {"CZK": 1.0}


@dataclass(frozen=True)
class Rates:
    """Rates to the home currency with what has to be said about them."""

    rates: dict[str, float]
    valid_date: str = ""
    cached: bool = False
    warnings: tuple[str, ...] = ()
    requests: int = 0

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.rates.items()), "currency string, rate double")


@dataclass
class RateProvider:
    """Stored rates while they are fresh, else fetched ones, else the last stored, else the home currency alone."""

    store: Snapshots
    fetch: Callable[[], tuple[dict[str, float], str]]
    ttl_hours: float = 12.0
    stale_days: int = 5

    def _age(self, valid: str, now: datetime) -> tuple[str, ...]:
        try:
            days = (now.date() - datetime.fromisoformat(valid).date()).days
        except ValueError:
            return ("the date of the rates is unknown",) if valid else ()
        return (f"rates are {days} days old",) if days > self.stale_days else ()

    def get(self, now: datetime, read_only: bool = False) -> Rates:
        table = self.store.read()
        rows = table.collect() if table is not None else []  # a row a currency
        known = {r["currency"]: r["rate"] for r in rows}
        valid, fetched = (rows[0]["valid_date"], rows[0]["fetched_at"]) if rows else ("", None)
        if known and fetched and fetched + timedelta(hours=self.ttl_hours) > now:
            return Rates(known, valid, True, self._age(valid, now))
        try:
            rates, day = self.fetch()
        except Exception as e:
            if known:
                return Rates(known, valid, True, (*self._age(valid, now), f"rates could not be fetched ({type(e).__name__}), the last known ones are used"), 1)
            return Rates(dict(HOME), "", False, (f"rates could not be fetched ({type(e).__name__}) and none are stored",), 1)
        rates = rates | HOME
        if not read_only:
            self.store.write(self.store.spark.createDataFrame([(c, float(r), day, now) for c, r in rates.items()], "currency string, rate double, valid_date string, fetched_at timestamp"))
        return Rates(rates, day, False, self._age(day, now), 1)


def is_rate_limited(error: Exception) -> bool:
    """SUP-11: the message names a refusal or a limit."""
    return any(code in str(error) for code in ("403", "429"))


def is_transient(error: Exception) -> bool:
    """SUP-06: worth one more try."""
    said = str(error).lower()
    return isinstance(error, TimeoutError) or any(w in said for w in ("timeout", "timed out", "429", "temporary"))


@dataclass
class SourceCycle:
    """Reads all sources of a cycle, each by itself: one that fails leaves the others alone, one that is limited rests.

    A read is planned and counted at once, so what fails does so here and not
    in the cycle's plan.  Pauses double from the poll interval up to a bound.
    """

    poll_seconds: float = 420.0
    most_seconds: float = 7200.0
    pauses: dict[str, tuple[float, float]] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def fetch(self, sources: dict[str, Callable[[], DataFrame]], now: float) -> DataFrame:
        """Union of what could be read; raises if nothing could and something failed."""
        self.errors, found = {}, []
        for name, read in sources.items():
            if now < self.pauses.get(name, (0.0, 0.0))[0]:
                continue
            try:
                try:
                    df = self._tried(read)
                except Exception as e:
                    if not is_transient(e) or is_rate_limited(e):
                        raise
                    df = self._tried(read)
                found.append(df)
                self.pauses.pop(name, None)
            except Exception as e:
                self.errors[name] = f"{type(e).__name__}: {str(e)[:300]}"
                if is_rate_limited(e):
                    before = self.pauses.get(name, (0.0, 0.0))[1]
                    delay = min(max(self.poll_seconds, 2 * before), self.most_seconds)
                    self.pauses[name] = (now + delay, delay)
        if not found:
            raise RuntimeError("no source could be read: " + "; ".join(f"{k}: {v}" for k, v in self.errors.items()) if self.errors else "every source rests")
        out = found[0]
        for df in found[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return out

    @staticmethod
    def _tried(read: Callable[[], DataFrame]) -> DataFrame:
        df = read()
        df.write.format("noop").mode("overwrite").save()  # every row is parsed once before it is let in
        return df


def enrich_prices(cards: DataFrame, stored: DataFrame, details: DataFrame) -> DataFrame:
    """``cards`` with a price for those that had none or couldn't be read (SRC-14).

    The stored listing's price comes first, then the detail page's (id, amount,
    currency); ``price_origin`` says which, and where neither has one the row stays as it was.
    """
    bad = F.col("price_status").isin("missing", "parse_error")
    old = stored.where("price_status NOT IN ('missing', 'parse_error')").select("id", F.col("price_amount").alias("_s_amount"), F.col("currency").alias("_s_ccy"), F.col("price_status").alias("_s_status"))
    new = details.select("id", F.col("amount").alias("_d_amount"), F.col("currency").alias("_d_ccy"))
    x = cards.join(old, "id", "left").join(new, "id", "left")
    kept, read = bad & F.col("_s_status").isNotNull(), bad & F.col("_s_status").isNull() & F.col("_d_amount").isNotNull()
    pick = lambda c, s, d: F.when(kept, s).when(read, d).otherwise(F.col(c)).alias(c)
    out = {
        "price_amount": pick("price_amount", F.col("_s_amount"), F.bround("_d_amount").cast(cards.schema["price_amount"].dataType)), "currency": pick("currency", F.col("_s_ccy"), F.coalesce("_d_ccy", "currency")),
        "price_status": pick("price_status", F.col("_s_status"), F.when(F.col("_d_amount") > 0, "numeric").otherwise("free")),
    }
    origin = F.when(kept, "stored").when(read, "detail").otherwise("card").alias("price_origin")
    return x.select(*(out.get(c, F.col(c)) for c in cards.columns if c != "price_origin"), origin)


def price_stats(cards: DataFrame) -> DataFrame:
    """(price_status, price_origin, n) of a cycle (AG-22)."""
    return cards.groupBy("price_status", "price_origin").agg(F.count("*").alias("n"))
