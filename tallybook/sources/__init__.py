"""Reading tables and streams; generators of weighted streams; stores of sketches."""
