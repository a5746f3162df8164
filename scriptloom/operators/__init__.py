"""Jobs over whole script, registry and conversation tables: DataFrame in, DataFrame out."""
