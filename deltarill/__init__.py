"""deltarill: delta-accumulative graph analytics and data-quality operators as Spark DataFrame plans."""
