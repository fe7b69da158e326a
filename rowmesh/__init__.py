"""rowmesh: sparse-matrix analytics expressed as Spark DataFrame plans."""
