"""Immutable, driver-side descriptions of trees and layers."""
