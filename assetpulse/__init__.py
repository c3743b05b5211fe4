"""assetpulse: asset-health analytics on Spark."""
