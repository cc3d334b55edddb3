"""Tables in and out: rasters, patches, configuration, reports."""
