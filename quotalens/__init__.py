"""quotalens: audits of worklists picked from a risk score, on Spark."""
