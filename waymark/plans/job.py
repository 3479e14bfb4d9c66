"""The whole run over one file of routes: read, resolve the places, report, and write unless it is a dry run.

    spark-submit waymark/plans/job.py SOURCE [TARGET] [--aliases CSV] [--preferred CSV]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from waymark.operators import places
from waymark.sources import geojson

# The rules of the surveyed data. A label and the place it stands for; a place's key and the form in which it is shown.
ALIASES = [
    ("EERSTERIVER", "EERSTE RIVER"),
    ("EERSTERIVIER", "EERSTE RIVER"),
    ("EERSTE RIVIER STASIE", "EERSTE RIVER STATION"),
    ("GUGULETU", "GUGULETHU"),
    ("HOUTBAY", "HOUT BAY"),
    ("MELKBOS", "MELKBOSSTRAND"),
    ("CASSA BLANCA (STRAND)", "CASSABLANCA"),
    ("TYGERVALLEY CENTRE", "TYGERVALLEY SHOPPING CENTRE"),
    ("SANDRIF", "SANDRIFT"),
    ("SANDDRIFT", "SANDRIFT"),
    ("PHILIPPI STATION TRANSPORT INTERCHANGE", "PHILIPPI STATION"),
    ("NYANGA STATION PUBLIC TRANSPORT INTERCHANGE", "NYANGA STATION"),
    ("NYANGA TERM", "NYANGA TERMINUS"),
    ("RAILWAY STATION (SOMERSET WEST)", "SOMERSET WEST STATION"),
]
PREFERRED = [
    ("TABLEVIEW", "TABLE VIEW"),
    ("SUMMERGREENS", "SUMMER GREENS"),
    ("MELKBOSSTRAND", "MELKBOSSTRAND"),
    ("BLOUBERGSTRAND", "BLOUBERGSTRAND"),
    ("LOWERCROSSROADS", "LOWER CROSS ROADS"),
    ("SAXONSEAATLANTIS", "SAXONSEA ATLANTIS"),
    ("CAPETOWNSTATIONDECK", "CAPE TOWN STATION DECK"),
    ("CROSSROADSJOBURGSTORES", "CROSS ROADS (JO-BURG STORES)"),
    ("TOWNCENTREMITCHELLSPLAIN", "TOWN CENTRE (MITCHELLS PLAIN)"),
    ("SANLAMCENTREPAROW", "SANLAM CENTRE, PAROW"),
    ("METROINDUSTRYPAARDENEILAND", "METRO INDUSTRY (PAARDEN EILAND)"),
    ("KRAMATWAYMACASSAR", "KRAMAT WAY (MACASSAR)"),
    ("MITCHELLSPLAINCALYPSOSQUARE", "MITCHELLS PLAIN (CALYPSO SQUARE)"),
    ("MITCHELLSPLAINTOWNCENTRE", "MITCHELLS PLAIN (TOWN CENTRE)"),
    ("EINDHOVENDELFT", "EINDHOVEN, DELFT"),
    ("LEIDENDELFT", "LEIDEN, DELFT"),
    ("FABRIEKSAREAATLANTIS", "FABRIEKS AREA, ATLANTIS"),
    ("LOURENSFORDSOMERSETWEST", "LOURENSFORD, SOMERSET WEST"),
]


def rules(spark: SparkSession, own: list[tuple[str, str]], columns: tuple[str, str], path: str | None = None) -> DataFrame:
    """A rule table of two columns: from a CSV file with a header, or the given pairs."""
    if path is not None:
        return spark.read.option("header", True).csv(path).toDF(*columns)
    return spark.createDataFrame(own, ", ".join(f"{c} string" for c in columns))


def run(spark: SparkSession, source: str, target: str | None = None, aliases: str | None = None, preferred: str | None = None) -> dict[str, DataFrame]:
    """summary, merges and reviews of the routes in a file, in their order. With a target, a new path, the routes are written there with their places; without, nothing is."""
    routes = geojson.read_routes(spark, source)
    tables = rules(spark, ALIASES, ("alias", "target"), aliases), rules(spark, PREFERRED, ("key", "display"), preferred)
    report = places.merge_report(routes, *tables)
    if target is not None:
        geojson.write_routes(places.normalise_places(routes, *tables), target, source)
    return {"summary": places.summary(routes, *tables), "merges": places.report_lines(report), "reviews": places.review_lines(places.merge_reviews(report))}


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("source")
    parser.add_argument("target", nargs="?")
    parser.add_argument("--aliases")
    parser.add_argument("--preferred")
    given = parser.parse_args()
    found = run(SparkSession.builder.getOrCreate(), given.source, given.target, given.aliases, given.preferred)
    for name, df in found.items():
        print(name)
        df.show(df.count(), truncate=False)


if __name__ == "__main__":
    main()
