"""python -m codeloom analyze ROOT STORE | cypher STORE QUERY | impact STORE NAME [in|out]"""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    if len(args) < 3 or args[0] not in ("analyze", "cypher", "impact"):
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession

    from .operators import tools
    from .plans import cypher
    from .plans.analyze import analyze
    from .sources.graph_store import GraphStore

    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    if args[0] == "analyze":
        print(analyze(spark, args[1], args[2])["stats"])
    elif args[0] == "cypher":
        print(cypher.markdown(cypher.run(GraphStore(spark, args[1]).read(), args[2])))
    else:
        graph = GraphStore(spark, args[1]).read()
        target = tools.resolve_target(graph, args[2]).select("id")
        reached = tools.impact(graph, target, args[3] if len(args) > 3 else "in")
        print(cypher.markdown(reached.join(graph.nodes.select("id", "label", "name", "filePath"), "id").orderBy("depth", "id")))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
