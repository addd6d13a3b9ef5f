"""Elevation services: batches of points to ask for, answers read back, and a chain of services under a budget."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.cluster import stored

# Points of a batch, by service.
BATCH = {"open-meteo": 100, "open-elevation": 200}


def batches(points: DataFrame, service: str, key: str = "request_id") -> DataFrame:
    """Adds ``batch`` and ``at`` (both from 0) to each request's points, which run by ``place``."""
    number = F.row_number().over(Window.partitionBy(key).orderBy("place")) - 1
    size = BATCH[service]
    return points.withColumns({"batch": F.floor(number / size).cast("long"), "at": (number % size).cast("long")})


def batch_bodies(batched: DataFrame, service: str, key: str = "request_id") -> DataFrame:
    """(key, batch, body): what a service is asked, one row a batch; a batch bounds the list."""
    points = F.array_sort(F.collect_list(F.struct("at", "lat", "lng")))
    rows = batched.groupBy(key, "batch").agg(points.alias("p"))
    text = lambda c: F.array_join(F.transform("p", lambda p: F.format_string("%.6f", p[c])), ",")
    if service == "open-meteo":
        return rows.select(key, "batch", F.concat(F.lit("latitude="), text("lat"), F.lit("&longitude="), text("lng")).alias("body"))
    places = F.transform("p", lambda p: F.struct(p["lat"].alias("latitude"), p["lng"].alias("longitude")))
    return rows.select(key, "batch", F.to_json(F.struct(places.alias("locations"))).alias("body"))


def read_answers(answers: DataFrame, service: str, key: str = "request_id") -> DataFrame:
    """(key, batch, at, elev) of recorded answers (key, batch, answer); a bad answer gives no rows."""
    if service == "open-meteo":
        values = F.from_json("answer", "struct<elevation: array<double>>")["elevation"]
    else:
        values = F.transform(F.from_json("answer", "struct<results: array<struct<elevation: double>>>")["results"], lambda r: r["elevation"])
    found = answers.select(key, "batch", F.posexplode(values).alias("at", "elev"))
    return found.where(F.col("elev").isNotNull() & ~F.isnan("elev")).withColumn("at", F.col("at").cast("long"))


def elevated(batched: DataFrame, answers: DataFrame, service: str, key: str = "request_id") -> DataFrame:
    """The points with ``elev`` from the recorded answers, null where there is none."""
    return batched.join(read_answers(answers, service, key), [key, "batch", "at"], "left")


#: Asks a service: (body of a batch, seconds left) to the answer's text. Raises TimeoutError if time runs out, anything
#: else if the service fails.
Transport = Callable[[str, float], str]


@dataclass(frozen=True)
class Provider:
    service: str
    ask: Transport


# Milliseconds of a request's lookup, of all its services together; points of a request.
BUDGET_MS, POINTS = 375, 800


def http(service: str, address: str) -> Transport:
    """A transport to a live service: a query string for "open-meteo", a JSON body for "open-elevation"."""

    def ask(body: str, seconds: float) -> str:
        if service == "open-meteo":
            request = urllib.request.Request(f"{address}?{body}")
        else:
            request = urllib.request.Request(address, body.encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=seconds) as answer:
                return answer.read().decode()
        except urllib.error.URLError as error:
            if isinstance(error.reason, TimeoutError):
                raise TimeoutError from error
            raise

    return ask


def _asked(ask: Transport, budget_ms: int, key: str, clock: Callable[[], float]):
    """Batches of one request in order, until the budget is spent or the service fails; answers so far are kept."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("batch", ignore_index=True)
        spent, answers, state = float(part["spent_ms"].iloc[0]), [], "asked"
        for body in part["body"]:
            answer = None
            if state == "asked" and spent >= budget_ms:
                state = "timed_out"
            if state == "asked":
                began = clock()
                try:
                    answer = ask(body, max(0.001, (budget_ms - spent) / 1000))
                except TimeoutError:
                    state = "timed_out"
                except Exception:  # the next service is asked for what is left
                    state = "failed"
                spent += 1000 * (clock() - began)
            answers.append(answer)
        return pd.DataFrame({key: part[key], "batch": part["batch"], "answer": answers, "spent_ms": spent, "state": state})

    return run


def look_up(points: DataFrame, providers: list[Provider], budget_ms: int = BUDGET_MS, most: int = POINTS, key: str = "request_id", clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """(key, place, lat, lng, elev, service): each request's distinct points with the first elevation that a service gives.

    points: key, place, lat, lng. Points equal to six decimals count once, as the one of least place; a request
    has at most ``most`` points, so a request's batches bound a task. A service is asked batch by batch.
    Answers that came before it failed, or before the budget was spent, stay. The next service is asked
    only for what has no elevation yet, and only for requests whose time has not run out; the budget is
    that of all services together. Points without an answer have a null elevation and service.
    """
    spot = F.format_string("%.6f,%.6f", F.col("lat"), F.col("lng"))
    one = points.groupBy(key, spot.alias("spot")).agg(F.min(F.struct("place", "lat", "lng")).alias("p")).select(key, "p.*")
    one = one.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where(F.col("_n") <= most).drop("_n")
    one = stored(one, "lookup-points")
    left, done = one.withColumn("spent_ms", F.lit(0.0)), None
    key_type = points.schema[key].dataType.simpleString()
    for provider in providers:
        batched = stored(batches(left, provider.service, key), "lookup-batches")
        spent = batched.groupBy(key).agg(F.max("spent_ms").alias("spent_ms"))
        bodies = batch_bodies(batched, provider.service, key).join(spent, key)
        answers = bodies.groupBy(key).applyInPandas(_asked(provider.ask, budget_ms, key, clock), f"{key} {key_type}, batch long, answer string, spent_ms double, state string")
        answers = stored(answers, "lookup-answers")  # asked once, whatever is lost later
        found = elevated(batched.drop("spent_ms"), answers.where("answer IS NOT NULL"), provider.service, key)
        found = stored(found.withColumn("service", F.when(F.col("elev").isNotNull(), F.lit(provider.service))), "lookup-found")
        got = found.where("elev IS NOT NULL").select(key, "place", "elev", "service")
        done = got if done is None else done.unionByName(got)
        state = answers.groupBy(key).agg(F.max("spent_ms").alias("spent_ms"), F.max(F.col("state") == "timed_out").alias("late"))
        left = found.where("elev IS NULL").select(key, "place", "lat", "lng").join(state.where("NOT late").select(key, "spent_ms"), key)
    if done is None:
        return one.withColumns({"elev": F.lit(None).cast("double"), "service": F.lit(None).cast("string")})
    return one.join(done, [key, "place"], "left").select(key, "place", "lat", "lng", "elev", "service")
