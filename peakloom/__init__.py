"""peakloom: spectrum search, candidate pools, text and graph evidence as Spark DataFrame programs."""
