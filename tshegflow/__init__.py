"""tshegflow: Tibetan-script text analytics expressed as Spark DataFrame plans."""
