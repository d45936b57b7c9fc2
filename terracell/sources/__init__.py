"""Sources and sinks: vector and raster files, catalogue pages, checked downloads. Parquet is the store; these get data in and out."""
