"""Tables in and out: catalog, readers, partitioned reads, writers."""
