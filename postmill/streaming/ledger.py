"""Recipient lists as the outcome of add and clear commands.

Commands are ``message_id, seq, op, kind, address``; op is add or clear, and a clear of kind all keeps Reply-To. An add
refused because the address was listed does not come back when that listing is cleared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from postmill.functions.address import address_key
from postmill.functions.arrays import none_of
from postmill.operators.ordered import carry_last, in_ranges, large_groups, on_keys, parted, running_total
from postmill.session import durable, stored

KINDS = ("to", "cc", "bcc", "Reply-To")
# Commands of a message that one task holds; an address has that many listings at most, and its fold copies them at each step.
MOST_COMMANDS = 1_000


def recipient_ledger(commands: DataFrame, most: int = MOST_COMMANDS) -> DataFrame:
    """Accepted adds of a batch of commands: ``message_id, seq, kind, address, listed``.

    ``listed`` tells whether the address is still there at the end. Clears cut a message into epochs. Messages of up to ``most``
    commands meet in one task each, and all steps hold there without another shuffle; longer ones go by ranges.
    """
    held = stored(commands.select("message_id", "seq", "op", "kind", "address"))
    small, large = parted(held, ["message_id"], large_groups(held, ["message_id"], F.lit(1), most))
    short = _short_ledger(small)
    return short if large is None else short.unionByName(_long_ledger(large))


def _spans(commands: DataFrame) -> DataFrame:
    """Commands along each kind they touch, as ``_kind``, and in ``_ended`` the epoch a clear begins."""
    kinds = F.when((F.col("op") == "clear") & (F.col("kind") == "all"), F.array(*[F.lit(k) for k in KINDS[:3]])).otherwise(
        F.array("kind")
    )
    return commands.withColumn("_kind", F.explode(kinds)).withColumns(
        {"_back": -F.col("seq"), "_ended": F.when(F.col("op") == "clear", F.col("epoch") + 1)}
    )


def _adds(commands: DataFrame) -> DataFrame:
    # A clear without ``seq`` sorts first either way; a listing ends after its own epoch all the same, so chains go forward.
    ended = F.when(F.col("ended").isNotNull(), F.greatest(F.col("ended"), F.col("epoch") + 1))
    return commands.filter("op = 'add'").withColumns(
        {"ended": ended, "_key": address_key(F.col("address")), "_reply": F.col("kind") == "Reply-To"}
    )


def _short_ledger(commands: DataFrame) -> DataFrame:
    """The ledger of messages whose commands one task can hold: windows and one fold per address, all on one shuffle."""
    is_clear = (F.col("op") == "clear").cast("bigint")
    earlier = Window.partitionBy("message_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    counted = commands.repartition("message_id").withColumn("epoch", F.coalesce(F.sum(is_clear).over(earlier), F.lit(0)))
    # When is a listing made in an epoch ended? At the next clear of its kind: look forward along each kind.
    later = Window.partitionBy("message_id", "_kind").orderBy("_back").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adds = _adds(_spans(counted).withColumn("ended", F.last("_ended", ignorenulls=True).over(later)))
    row = F.struct("epoch", "seq", "ended", "kind", "address")
    listings = adds.groupBy("message_id", "_reply", "_key").agg(F.array_sort(F.collect_list(row)).alias("_adds"))
    # ``free`` is the first epoch in which the address can be listed again; null: in none.
    start = F.struct(F.lit(0).cast("bigint").alias("free"), none_of(F.get("_adds", F.lit(0))).alias("taken"))

    def step(state: Column, add: Column) -> Column:
        listed = F.struct(add["ended"].alias("free"), F.concat(state["taken"], F.array(add)).alias("taken"))
        return F.when(add["epoch"] >= state["free"], listed).otherwise(state)

    taken = F.aggregate("_adds", start, step, lambda state: state["taken"])
    return listings.select("message_id", F.inline(taken)).select(
        "message_id", "seq", "kind", "address", F.col("ended").isNull().alias("listed")
    )


def _long_ledger(commands: DataFrame) -> DataFrame:
    """The ledger by ranges of commands. Within an epoch, only the first add of an address can be accepted, so all others go before
    the shuffle. What is left per address is one row per epoch at most, a chain of which is accepted."""
    is_clear = (F.col("op") == "clear").cast("bigint")
    blocked = in_ranges(commands, ["message_id"], ["seq"], "_block")
    counted = running_total(blocked, ["message_id"], ["seq"], is_clear, "epoch", "_block")

    along = _spans(counted).withColumn("_back_block", -F.col("_block"))
    ended = carry_last(along, ["message_id", "_kind"], ["_back"], "_ended", "ended", "_back_block")
    adds = _adds(ended)
    first = Window.partitionBy("message_id", "_reply", "_key", "epoch").orderBy("seq")
    candidates = adds.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")

    group = ["message_id", "_reply", "_key"]
    held = durable(candidates.select(*group, "epoch", "ended", "seq", "kind", "address"))
    taken = _chains(held, group)
    return on_keys(held, taken, [*group, "epoch"]).select("message_id", "seq", "kind", "address", F.col("ended").isNull().alias("listed"))


def _chains(candidates: DataFrame, group: list[str]) -> DataFrame:
    """``group, epoch`` of the candidates that are taken: the first of each group, and after each taken one the first that is free.

    A candidate's successor is the next candidate at or after the epoch that ends its listing. Chains of successors are followed by
    pointer doubling: in each round the reached part of a chain doubles, and so does how far its links jump. All joins are on
    (group, epoch), so one address with very many epochs is spread over the tasks.
    """
    node = [*group, "epoch"]
    down = lambda at: (-F.col(at)).alias("_down")
    places = candidates.select(*group, down("epoch"), F.lit(0).alias("_asks"), F.col("epoch").alias("_next"), F.lit(None).cast("bigint").alias("epoch"))
    asked = candidates.filter("ended is not null").select(
        *group, down("ended"), F.lit(1).alias("_asks"), F.lit(None).cast("bigint").alias("_next"), "epoch"
    )
    order = ["_down", "_asks"]
    along = in_ranges(places.unionByName(asked), group, order, "_block")
    found = carry_last(along, group, order, "_next", "next", "_block").filter("_asks = 1 and next is not null")
    jumps = durable(found.select(*node, "next"))
    reached = durable(candidates.groupBy(*group).agg(F.min("epoch").alias("epoch")))
    fresh = reached
    while True:
        fresh = durable(on_keys(reached, jumps, node).select(*group, F.col("next").alias("epoch")))
        if fresh.isEmpty():
            return reached
        reached = durable(reached.unionByName(fresh))
        onward = jumps.select(*group, F.col("epoch").alias("next"), F.col("next").alias("_far"))
        jumps = durable(on_keys(jumps, onward, [*group, "next"]).select(*node, F.col("_far").alias("next")))


class LedgerProcessor(StatefulProcessor):
    """Keeps, per message, in which list each address is, and how often each list was cleared.

    A listing holds as long as its list has been cleared no more often than when it was made, so a clear touches one number.
    State is read once and written once per address and batch of a message.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.listed = handle.getMapState("listed", "name string", "kind string, cleared bigint", self.ttl_ms)
        self.cleared = handle.getMapState("cleared", "kind string", "n bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        names = batch["kind"].eq("Reply-To").map({True: "r:", False: "m:"}) + batch["address"].fillna("").str.lower()
        cleared = {(kind,): self.cleared.getValue((kind,))[0] if self.cleared.containsKey((kind,)) else 0 for kind in KINDS}
        listed: dict[str, tuple[str, int] | None] = {}
        changed, taken = set(), []
        for at, (op, kind, name) in enumerate(zip(batch["op"], batch["kind"], names)):
            if op == "clear":
                for gone in KINDS[:3] if kind == "all" else (kind,):
                    cleared[gone,] = cleared.get((gone,), 0) + 1
                continue
            if name not in listed:
                listed[name] = tuple(self.listed.getValue((name,))) if self.listed.containsKey((name,)) else None
            held = listed[name]
            if held is None or cleared.get((held[0],), 0) > held[1]:
                listed[name] = (kind, cleared.get((kind,), 0))
                changed.add(name)
                taken.append(at)
        for name in changed:
            self.listed.updateValue((name,), listed[name])
        # Written anew each time: the counts must outlive every listing that was made under them.
        for kind, n in cleared.items():
            if n:
                self.cleared.updateValue(kind, (n,))
        yield batch.iloc[taken][["seq", "kind", "address"]].assign(message_id=key[0])[["message_id", "seq", "kind", "address"]]

    def close(self) -> None:
        pass


def live_ledger(commands: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Accepted adds of a stream of commands. Commands of a message arrive in order from one micro-batch to the next;
    within one they are sorted, so bound a micro-batch at its source (``maxBytesPerTrigger``). Needs the RocksDB state
    store: ``spark.sql.streaming.stateStore.providerClass``.

    With ``ttl_ms``, a listing is forgotten so long (in processing time) after it was made, and the address may be listed again; the
    state of a message without commands then ends. Without, it is kept for good."""
    return commands.groupBy("message_id").transformWithStateInPandas(
        statefulProcessor=LedgerProcessor(ttl_ms),
        outputStructType="message_id bigint, seq bigint, kind string, address string",
        outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )
