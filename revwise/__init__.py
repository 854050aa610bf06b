"""revwise: customer-review analytics expressed as Spark DataFrame plans.

Every public function takes DataFrames (plus plain parameters) and returns a
DataFrame; nothing collects data to the driver.  See README.md for the map
from operator ids to modules.
"""

__version__ = "0.1.0"
