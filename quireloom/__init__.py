"""quireloom: document routing, retrieval and corpus preparation as Spark plans."""
