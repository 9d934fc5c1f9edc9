"""brinework: business KPIs, dataset profiling, cleaning and chart data as Spark DataFrame operators."""
