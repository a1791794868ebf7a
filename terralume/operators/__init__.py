"""DataFrame operators over scenes, pixels, regions, tiles and verdicts."""
