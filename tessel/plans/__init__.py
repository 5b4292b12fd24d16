"""Expression trees and the query catalogue."""
